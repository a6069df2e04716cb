"""Secrets in texts, also below nested encodings.

A worklist starts with the text itself. Each layer is scanned, and its encoded parts (percent and
backslash escapes, base64, zlib or gzip below base64) become new layers until none is left that this
document hasn't seen, so cycles end. A find in a layer is mapped back: to its own characters through
escapes, to the whole run through base64 and compression.

Base64 is decoded run by run, and lines of equal width that follow each other also as one. Whatever decodes is a
layer: UTF-8 with bad bytes replaced and, if there are zero bytes, UTF-16 of both orders; the rules
decide. Compressed data is unpacked until no header is left, and unpacked data of more than
``PIECE`` bytes is scanned in pieces that overlap by ``OVERLAP``, which bounds a task's memory; only a find
or an encoded run longer than that can be cut between two pieces.

Null and empty texts give no spans; repeated rows are scanned each on its own; a null id is kept;
other columns are ignored.
"""

import base64
import binascii
import hashlib
import re
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm.text import small_batches

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP = 16 << 20, 1 << 20
# The patterns of the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_rules = {
    "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE),
    "access": re.compile(ACCESS),
    "hex": re.compile(HEX),
    "percent": re.compile(r"[^\s%]*(?:%[0-9A-Fa-f]{2}[^\s%]*)+"),
    "escape": re.compile(r"[^\s\\]*(?:\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})[^\s\\]*)+"),
    "base64": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    "wrapped": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}"),
    "unit": re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+)"),
}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one layer, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in _rules["assign"].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _rules["access"].finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in _rules["hex"].finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _unescaped(run: str):
    """Decoded run and, for each of its characters, the span of the run that it came from."""
    out, spans, at = [], [], 0
    for m in _rules["unit"].finditer(run):
        for i in range(at, m.start()):
            out.append(run[i])
            spans.append((i, i + 1))
        at = m.end()
        if m[1]:
            raw = bytes.fromhex(m[1].replace("%", ""))
            piece, width = raw.decode("utf-8", "replace"), 3
            steps = [len(c.encode()) * width for c in piece]
            if sum(steps) != len(m[1]):  # not UTF-8: each byte for itself
                piece, steps = raw.decode("latin-1"), [width] * len(raw)
        else:
            piece, steps = "", []
            for u in re.findall(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", m[2]):
                c = chr(int(u[2:], 16))
                if piece and "\ud800" <= piece[-1] <= "\udbff" and "\udc00" <= c <= "\udfff":
                    piece = piece[:-1] + (piece[-1] + c).encode("utf-16", "surrogatepass").decode("utf-16")
                    steps[-1] += len(u)
                else:
                    piece += c
                    steps.append(len(u))
        place = m.start()
        for c, step in zip(piece, steps):
            out.append(c)
            spans.append((place, place + step))
            place += step
    for i in range(at, len(run)):
        out.append(run[i])
        spans.append((i, i + 1))
    return "".join(out), spans


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0)


def _steps(source):
    """Bytes below one layer of compression, a step at a time; a broken stream gives what it held."""
    unpack = None
    for part in source:
        full = False
        while part or full:
            if unpack is None:
                unpack = zlib.decompressobj(wbits=47)
            try:
                out = unpack.decompress(part, PIECE)
            except zlib.error:
                return
            if out:
                yield out
            if unpack.eof:  # another member may follow
                part, full = unpack.unused_data, False
                if not _packed(part):
                    return
                unpack = None
            else:
                part, full = unpack.unconsumed_tail, len(out) == PIECE


def _pieces(raw: bytes):
    """Pieces of what lies below all compression; each repeats the last ``OVERLAP`` bytes of the one before."""
    source, head, seen = iter([raw]), raw, set()
    while _packed(head) and (mark := hashlib.sha256(head).digest()) not in seen:
        seen.add(mark)
        below = _steps(source)
        start = next(below, None)
        if start is None:  # not compressed after all
            source = iter([head])
            break
        while len(start) < 3 and (more := next(below, None)) is not None:
            start += more
        more = next(below, None)
        source, head = iter([start]) if more is None else chain([start, more], below), start
    held = b""
    for part in source:
        held += part
        while len(held) > PIECE:
            yield held[:PIECE]
            held = held[PIECE - OVERLAP :]
    if held:
        yield held


def _decoded(raw: bytes):
    yield raw.decode("utf-8", "replace")
    if 0 in raw:
        yield raw.decode("utf-16-le", "replace")
        yield raw.decode("utf-16-be", "replace")


def _unpacked(run: str):
    """Texts below a base64 run, unpacked if it is compressed."""
    core = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return
    try:
        raw = base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    for piece in _pieces(raw):
        yield from _decoded(piece)


def _wrapped(text: str):
    """Lines of equal width that follow each other, and the shorter one behind them: joined, with their span."""
    for m in _rules["wrapped"].finditer(text):
        lines = [(x.start() + m.start(), x.end() + m.start(), x[0]) for x in re.finditer(r"[^\s]+", m[0])]
        at = 0
        while at < len(lines):
            width, to = len(lines[at][2]), at + 1
            while to < len(lines) and len(lines[to][2]) == width:
                to += 1
            if to < len(lines) and len(lines[to][2]) < width:
                to += 1
            if to - at > 1:
                yield "".join(x for *_, x in lines[at:to]), (lines[at][0], lines[to - 1][1])
            at = max(to, at + 1)


def _inner(text: str):
    """Layers directly below one: (text, span of each character or the one span of all)."""
    if "%" in text:
        for m in _rules["percent"].finditer(text):
            out, spans = _unescaped(m[0])
            yield "percent", out, [(a + m.start(), b + m.start()) for a, b in spans]
    if "\\" in text:
        for m in _rules["escape"].finditer(text):
            out, spans = _unescaped(m[0])
            yield "escape", out, [(a + m.start(), b + m.start()) for a, b in spans]
    for m in _rules["base64"].finditer(text):
        for out in _unpacked(m[0]):
            yield "base64", out, m.span()
    if "\n" in text:
        for run, span in _wrapped(text):
            for out in _unpacked(run):
                yield "base64", out, span


def scan_text(text: str | None):
    """(base spans, all spans, finds below layers) of one text."""
    text = text or ""
    mark = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()
    base = plain_spans(text)
    deep, seen, work = [], set(), [(text, _inner(text), None, "")]
    while work:
        layer, layers, place, path = work[-1]
        kind, below, spans = next(layers, (None, None, None))
        if kind is None:
            work.pop()
            continue
        if isinstance(spans, list) and place is not None:
            spans = place if isinstance(place, tuple) else [(place[a][0], place[b - 1][1]) for a, b in spans]
        elif isinstance(spans, tuple) and place is not None:
            spans = place if isinstance(place, tuple) else (place[spans[0]][0], place[spans[1] - 1][1])
        key = (mark(below), spans if isinstance(spans, tuple) else (spans[0][0], spans[-1][1]))
        if key in seen or below == layer:
            continue
        seen.add(key)
        for found, a, b in plain_spans(below):
            s, e = spans if isinstance(spans, tuple) else (spans[a][0], spans[b - 1][1])
            deep.append((found, s, e, f"{path}>{kind}"[1:]))
        work.append((below, _inner(below), spans, f"{path}>{kind}"))
    every = sorted({*base, *((k, a, b) for k, a, b, _ in deep)}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return base, every, sorted(set(deep), key=lambda x: (x[1], KINDS.index(x[0]), x[2], x[3]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base and all spans, and the finds below encodings with their path."""
    small_batches(docs.sparkSession)
    kinds = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>, layers array<string>"
    three = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches):
        for batch in batches:
            out = [scan_text(t) for t in batch.column(1).to_pylist()]
            named = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
            yield pa.record_batch(
                [batch.column(0), pa.array([named(x[0]) for x in out], three), pa.array([named(x[1]) for x in out], three),
                 pa.array([[f"{k}:{a}:{b}:{p}" for k, a, b, p in x[2]] for x in out], pa.list_(pa.string()))],
                ["doc_id", "base", "spans", "layers"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, kinds)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of scanned rows."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "layers"
    )
