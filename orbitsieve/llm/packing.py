"""Hierarchical packing of tokenized documents into context windows of several lengths.

Documents are routed to the tier (window length) that holds them; longer ones fill whole windows of
the longest tier first and their rest is routed. Each tier, longest first, opens windows for its
documents and fills the gaps from shorter tiers: the longest document that fits, and at last a cut
piece of a shorter one. What remains at the end of a round is cut into windows of powers of two, so
there is no padding at all. Windows of one tier are dealt to training steps in snake order of their
attention cost, so that steps of a tier have equal tokens and nearly equal work.

Work is local to input partitions and to rounds of about ``ROUND`` tokens, so memory doesn't follow
the partition and nothing is shuffled. The result depends on how the input is split, as packing may.

Null and empty texts consist of the end token. Repeated rows and null ids are packed like others;
other columns are ignored.
"""

import json
import zlib
from bisect import bisect_right, insort
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm import text as tx

TIERS = (2048, 1024, 512)
ROUND = 4_000_000
STEP_TOKENS = 65_536
END = 1
# Classes of bytes for cutting into pieces as the tokenizer does: 0 letter, 1 digit, 2 white space, 3 other.
CLASS = np.full(256, 3, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
CLASS[48:58] = 1
CLASS[[9, 10, 11, 12, 13, 32]] = 2


def _ranked(tokenizer: str):
    """The same byte-level vocabulary as ranks, which encodes pieces that are cut already much faster; None if its
    merges aren't in the order of its ids."""
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    if merged != sorted(merged):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and (len(t) == 1 or i >= merged[0])}
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i <= merged[-1]}
    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts. Pieces of plain Latin texts are cut by array work and encoded once each;
    all other texts go through the tokenizer as they are, with the same ids."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.quick = _ranked(tokenizer)
        self.known: dict[int, int] = {}
        self.pool, self.at, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), [0, 0]

    def _plain(self, data, off):
        """Texts made only of ASCII without apostrophes or control characters, and Latin-1 letters."""
        bad = (data == 39) | ((data < 32) & (CLASS[data] != 2)) | (data == 127)
        high = data >= 128
        lead = data == 0xC3
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        bad |= high & ~lead & ~after
        bad |= after & ((data == 0x97) | (data == 0xB7))
        sums = np.concatenate([[0], np.cumsum(bad)])
        return sums[off[1:]] == sums[off[:-1]]

    def _pieces(self, data, off):
        kind = CLASS[data]
        start = np.zeros(len(data) + 1, bool)
        start[off] = True
        first = start[:-1].copy()
        start = start[:-1]
        start[1:] |= kind[1:] != kind[:-1]
        word = np.flatnonzero(kind != 2)
        word = word[(word > 0)]
        word = word[start[word] & ~first[word] & (kind[word - 1] == 2)]  # after white space of the same text
        start[word - 1] = True
        start[word[data[word - 1] == 32]] = False
        return np.flatnonzero(start)

    def ids(self, column):
        """Ids (uint16 or wider) of each text of a string column, one after another."""
        for first, last, data, off in tx.blocks(column, 2 << 20):
            plain = self._plain(data, off) if len(data) else np.ones(last - first, bool)
            if len(data) and plain.any():
                if b"<|endoftext|>" in data.tobytes():
                    plain &= np.array([b"<|endoftext|>" not in data[a:b].tobytes() for a, b in zip(off[:-1], off[1:])])
                starts = self._pieces(data, off)
                ends = np.concatenate([starts[1:], [len(data)]])
                keep = np.repeat(plain, np.diff(np.searchsorted(starts, off)))
                starts, ends = starts[keep], ends[keep]
                where = np.searchsorted(starts, off)
                hashes = tx.span_hashes(tx.prefix_sums(data), starts, ends)
                inverse, names = pd.factorize(hashes)
                one = np.empty(len(names), np.int64)
                one[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
                get = self.known.get
                slot = np.array([get(h, -1) for h in names.tolist()], np.int64)
                new = np.flatnonzero(slot < 0)
                if len(new):
                    raw = data.tobytes()
                    spans = zip(starts[one[new]].tolist(), ends[one[new]].tolist())
                    self._learn(new, names, slot, list(self.encode([raw[a:b].decode() for a, b in spans])))
                pool, at, slot = self.pool, self.at, slot[inverse]
                size = at[slot + 1] - at[slot]
                total = np.concatenate([[0], np.cumsum(size)])
                flat = pool[np.repeat(at[slot] - total[:-1], size) + np.arange(total[-1])]
            for i in range(last - first):
                if not plain[i]:
                    yield np.array(self.whole.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                elif len(data):
                    yield flat[total[where[i]] : total[where[i + 1]]]
                else:
                    yield np.zeros(0, np.uint32)

    def _learn(self, new, names, slot, got):
        pieces, used = self.used
        size = np.fromiter(map(len, got), np.int64, len(got))
        need = used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.resize(self.pool, 2 * need)
        if pieces + len(got) + 1 > len(self.at):
            self.at = np.resize(self.at, 2 * (pieces + len(got) + 1))
        self.pool[used:need] = np.fromiter(chain.from_iterable(got), np.uint32, need - used)
        self.at[pieces : pieces + len(got) + 1] = used + np.concatenate([[0], np.cumsum(size)])
        slot[new] = np.arange(pieces, pieces + len(got))
        self.known.update(zip(names[new].tolist(), slot[new].tolist()))
        self.used = [pieces + len(got), need]

    def encode(self, texts):
        if self.quick is not None:
            yield from map(self.quick.encode_ordinary, texts)
            return
        for e in self.whole.encode_batch_fast(texts, add_special_tokens=False):
            yield e.ids


def plan(lengths: list[int], tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length); each is full, of a tier's or a power of two's length."""
    windows: list[list[tuple[int, int, int]]] = []
    top = tiers[0]
    shelf: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length left, document, start), sorted
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            windows.append([(doc, at, top)])
            at += top
        if n > at:
            t = max(i for i, size in enumerate(tiers) if size >= n - at)
            shelf[t].append((n - at, doc, at))
    for s in shelf:
        s.sort()

    def fill(room, pieces, t):
        while room:
            for s in shelf[t:]:  # the longest that fits, from the longest tier that has one
                i = bisect_right(s, (room, 1 << 62, 0))
                if i:
                    n, doc, at = s.pop(i - 1)
                    pieces.append((doc, at, n))
                    room -= n
                    break
            else:
                s = next((s for s in reversed(shelf) if s), None)
                if s is None:
                    return room
                n, doc, at = s.pop()  # none fits: cut a short one
                pieces.append((doc, at, room))
                insort(next(x for x, size in zip(reversed(shelf), reversed(tiers)) if size >= n - room), (n - room, doc, at + room))
                return 0
        return 0

    for t, size in enumerate(tiers):
        while shelf[t]:
            n, doc, at = shelf[t].pop()
            pieces = [(doc, at, n)]
            room = fill(size - n, pieces, t)
            if room:  # nothing is left: cut the last window into powers of two
                windows += _binary(pieces)
            else:
                windows.append(pieces)
    return windows


def _binary(pieces):
    out, pieces = [], pieces[::-1]
    left = sum(p[2] for p in pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        window, room = [], size
        while room:
            doc, at, n = pieces.pop()
            take = min(n, room)
            window.append((doc, at, take))
            if n > take:
                pieces.append((doc, at + take, n - take))
            room -= take
        out.append(window)
        left -= size
    return out


def steps(windows, tiers=TIERS, step_tokens=STEP_TOKENS) -> list[int]:
    """Step of each window within its tier, in snake order of attention cost."""
    out = [0] * len(windows)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by.setdefault(sum(p[2] for p in w), []).append(i)
    base = 0
    for size, members in sorted(by.items(), reverse=True):
        count = -(-len(members) * size // step_tokens)
        members.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i]))
        for rank, i in enumerate(members):
            turn, place = divmod(rank, count)
            out[i] = base + (place if turn % 2 == 0 else count - 1 - place)
        base += count
    return out


def pack_documents(docs: DataFrame, tokenizer: str, tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    ``tiers`` are descending powers of two. ``with_ids`` adds the piece's token ids.
    """
    tx.small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
    kinds = ", ".join(f"{x} long" for x in names) + (", ids array<long>" if with_ids else "")

    def packed(ids, tokens, state):
        windows = plan([len(t) for t in tokens], tiers)
        step = steps(windows, tiers, step_tokens)
        rows = []
        for w, s in zip(windows, step):
            size, offset = sum(p[2] for p in w), 0
            for doc, at, n in w:
                piece = tokens[doc][at : at + n]
                rows.append((ids[doc], at, n, zlib.crc32(piece.astype("<u4").tobytes()), len(tokens[doc]), state[0], offset, size, state[1] + s)
                            + ((piece.tolist(),) if with_ids else ()))
                offset += n
            state[0] += 1
        state[1] += max(step, default=-1) + 1
        for i in range(0, len(rows), 20_000):
            cols = list(zip(*rows[i : i + 20_000]))
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in cols[:9]] + ([pa.array(cols[9], pa.list_(pa.int64()))] if with_ids else []),
                names + ["ids"] * with_ids,
            )

    def rows(batches):
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        state, ids, tokens, held = [base, base], [], [], 0
        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids.append(doc)
                tokens.append(np.append(got, got.dtype.type(END)))
                held += len(got) + 1
                if held >= ROUND:
                    yield from packed(ids, tokens, state)
                    ids, tokens, held = [], [], 0
        if ids:
            yield from packed(ids, tokens, state)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, kinds)
