"""Exact removal of byte strings that also occur in a document with a smaller id.

Suffixes are taken at anchors: the minimum of a rolling hash over every window of ``LENGTH`` bytes, so
that equal strings of that length have the same anchor in them.

1. Sieve: each task sorts the fingerprints of its anchors into runs, delta-codes them by range and
   exchanges whole runs. Merging a range shows which anchors occur in several documents.
2. Suffixes: documents with such anchors send the suffix at each anchor with what stands before it,
   again as sorted runs, front-coded: only what differs from the run's previous suffix is sent. Runs
   are merged word by word, and a word is only compared between suffixes whose words so far are equal,
   so known common prefixes are never compared again.
3. Among merged suffixes, equal windows are found by their place around the anchor; a window of a
   larger id than the smallest that has it is marked.
4. Marked windows of a document are joined to its text and cut.

Runs travel as a few binary rows per task and range, so Spark moves blocks, not suffixes.

Texts are UTF-8 bytes, null is empty. Texts below ``LENGTH`` bytes stay. Rows with the same id never
remove each other's bytes and share marks only if their texts are equal; a null id neither removes
nor loses anything. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm import text as tx
from orbitsieve.scratch import written

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
WIDTH = 80  # anchor's gram, what follows, what precedes (turned), how much of both; padded to words
PART, BLOCK = 6 << 20, 1 << 18
SIEVE = np.uint64(16)  # low bits of a fingerprint that the sieve leaves out; what it lets through is compared in full


def anchors(data: np.ndarray, off: np.ndarray):
    """(window starts, their anchors, hash of each position's gram) of a block of texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    sums = tx.prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    h = tx.span_hashes(sums, at, at + GRAM)
    bits = np.uint64(int(n).bit_length())
    low = (h >> bits << bits) | at.astype(np.uint64)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(low) - (SIDE - 15)], low[SIDE - 15 :])  # minimum over SIDE + 1 grams
    size = np.diff(off)
    room = np.maximum(size - LENGTH + 1, 0)
    first = np.concatenate([[0], np.cumsum(room)])
    starts = np.arange(first[-1]) + np.repeat(off[:-1] - first[:-1], room)
    where = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return starts, where, h


def _planes(x: np.ndarray, size: int) -> bytes:
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes(), codec="zstd", asbytes=True)


def _unplanes(raw, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).reshape(-1).view(kind)


def merged_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words; runs that are sorted already are merged, and a later word is
    only looked at among rows that agree in all earlier ones."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for c in range(1, words.shape[1]):
        if not tied.any():
            break
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        at = np.flatnonzero(open_)
        group = np.cumsum(~tied)[at]
        rows = order[at]
        sub = np.lexsort((words[rows, c], group))
        order[at] = rows[sub]
        same = np.zeros(len(order), bool)
        same[1:] = words[order[1:], c] == words[order[:-1], c]
        tied &= same
    return order


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix with the previous row, and the bytes after it, of sorted rows."""
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    shared = np.concatenate([[0], shared]).astype(np.uint8)
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def front_decoded(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= shared[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = rest
    at = np.arange(len(rows))
    for c in range(width):  # each column's byte comes from the last row that has its own
        rows[:, c] = rows[np.maximum.accumulate(np.where(own[:, c], at, 0)), c]
    return rows


def _ranges(spark) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(16, max(4, (8 * parts - 1).bit_length()))


def _by_range(batches, close):
    """Rows (range, ...) sorted by range, gathered range by range."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() if i == 0 or pa.types.is_integer(c.type) else c for i, c in enumerate(batch.columns))):
            if row[0] != now and held:
                yield from close(held)
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield from close(held)


def _lists(doc, *columns, kind=pa.int64()):
    """Arrow arrays: distinct doc and, for each column, the list of its values; doc is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    at = pa.array(np.append(starts, len(doc)), pa.int32())
    return [pa.array(doc[starts])] + [pa.ListArray.from_arrays(at, pa.array(c, kind)) for c in columns]


def _shared_anchors(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, places): anchors of each document that other documents have, too."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def runs(batches):
        held, size = [], 0

        def close():
            h, doc, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            h, doc, pos = h[order], doc[order], pos[order]
            cut = np.searchsorted(h >> shift, np.arange(ranges + 1, dtype=np.uint64))
            out = []
            for r in range(ranges):
                a, b = cut[r], cut[r + 1]
                if b > a:
                    step = np.diff(h[a:b] >> SIEVE, prepend=np.uint64(0))
                    out.append((r, int(b - a), _planes(step, 8), _planes(doc[a:b], 8), _planes(pos[a:b].astype(np.uint32), 4)))
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                ["range", "n", "h", "doc", "pos"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, off in tx.blocks(batch.column(1), BLOCK):
                starts, where, h = anchors(data, off)
                if not len(starts):
                    continue
                of = np.searchsorted(off, starts, side="right") - 1
                new = np.concatenate([[True], (where[1:] != where[:-1]) | (of[1:] != of[:-1])])
                where, of = where[new], of[new]
                held.append((h[where], ids[first + of], where - off[of]))
                size += len(data)
                if size > PART:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    def common(batches):
        def close(rows):
            h = np.concatenate([np.cumsum(_unplanes(x[2].as_buffer(), x[1], np.uint64), dtype=np.uint64) for x in rows])
            doc = np.concatenate([_unplanes(x[3].as_buffer(), x[1], np.int64) for x in rows])
            pos = np.concatenate([_unplanes(x[4].as_buffer(), x[1], np.uint32) for x in rows])
            order = np.argsort(h, kind="stable")  # merges the sorted runs
            h, doc, pos = h[order], doc[order], pos[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
            keep = np.repeat(several, np.diff(np.append(starts, len(h))))
            doc, pos = doc[keep], pos[keep]
            order = np.argsort(doc, kind="stable")
            yield pa.record_batch(_lists(doc[order], pos[order].astype(np.int32), kind=pa.int32()), ["doc_id", "places"])

        yield from _by_range(batches, close)

    return (
        docs.mapInArrow(runs, "range long, n long, h binary, doc binary, pos binary")
        .repartition("range").sortWithinPartitions("range")
        .mapInArrow(common, "doc_id long, places array<int>")
        .groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    )


def _suffixes(data, off, places):
    """Rows of suffixes at the given anchors (per text), with text, first window, gram hash."""
    starts, where, h = anchors(data, off)
    if not len(starts):
        return None
    of = np.searchsorted(off, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (of[1:] != of[:-1])]))
    lo, hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    at, of = where[new], of[new]
    marked = np.zeros(len(data) + 1, bool)
    for i, p in enumerate(places):
        marked[off[i] + p] = True
    keep = marked[at]
    lo, hi, at, of = lo[keep], hi[keep], at[keep], of[keep]
    if not len(at):
        return None
    left, right = at - lo, hi + LENGTH - at - GRAM
    rows = np.zeros((len(at), WIDTH), np.uint8)
    ahead = at[:, None] + np.arange(LENGTH)
    rows[:, :LENGTH] = np.where(np.arange(LENGTH) < GRAM + right[:, None], data[np.minimum(ahead, len(data) - 1)], 0)
    back = at[:, None] - 1 - np.arange(SIDE)
    rows[:, LENGTH : LENGTH + SIDE] = np.where(np.arange(SIDE) < left[:, None], data[np.maximum(back, 0)], 0)
    rows[:, LENGTH + SIDE], rows[:, LENGTH + SIDE + 1] = left, right
    return rows, of, at - off[of], h[at]


def _marks(docs: DataFrame, shared: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, spans): byte spans (start, end, flat) of each document to remove."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def runs(batches):
        held, size = [], 0

        def close():
            rows, doc, at, h = (np.concatenate(x) for x in zip(*held))
            r = (h >> shift).astype(np.int64)
            order = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[order], np.arange(ranges + 1))
            out = []
            for k in range(ranges):
                part = order[cut[k] : cut[k + 1]]
                if len(part):
                    part = part[merged_order(rows[part].view(">u8").astype(np.uint64))]
                    lcp, rest = front_coded(rows[part])
                    out.append((k, len(part), len(rest), lcp.tobytes(), pa.compress(rest, codec="zstd", asbytes=True), _planes(doc[part], 8), _planes(at[part].astype(np.uint32), 4)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["range", "n", "size", "lcp", "rest", "doc", "pos"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            for first, last, data, off in tx.blocks(batch.column(1), BLOCK):
                got = _suffixes(data, off, [places[i].values.to_numpy() for i in range(first, last)])
                if got is None:
                    continue
                rows, of, at, h = got
                held.append((rows, ids[first + of], at, h))
                size += rows.size
                if size > PART:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    def marked(batches):
        def close(runs):
            rows = np.concatenate([
                front_decoded(np.frombuffer(x[3].as_buffer(), np.uint8), np.frombuffer(pa.decompress(x[4].as_buffer(), x[2], codec="zstd"), np.uint8), WIDTH)
                for x in runs
            ])
            doc = np.concatenate([_unplanes(x[5].as_buffer(), x[1], np.int64) for x in runs])
            at = np.concatenate([_unplanes(x[6].as_buffer(), x[1], np.uint32) for x in runs]).astype(np.int64)
            words = rows.view(">u8").astype(np.uint64)
            order = merged_order(words)
            rows, doc, at, words = rows[order], doc[order], at[order], words[order]
            n = len(rows)
            gram = np.cumsum(np.concatenate([[False], (words[1:, : GRAM // 8] != words[:-1, : GRAM // 8]).any(1)])).astype(np.uint64)
            del words, order
            left, right = rows[:, LENGTH + SIDE].astype(int), rows[:, LENGTH + SIDE + 1].astype(int)
            ahead, behind = [tx.mix(gram + np.uint64(1))], [np.zeros(n, np.uint64)]
            for j in range(SIDE):
                ahead.append(tx.mix(ahead[-1] * np.uint64(0x9FB21C651E98DF25) + rows[:, GRAM + j]))
                behind.append(tx.mix(behind[-1] * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, LENGTH + j] + np.uint64(1)))
            hit = np.zeros((n, SIDE + 2), bool)  # by bytes before the anchor, with an empty last column
            for d in range(SIDE + 1):
                live = np.flatnonzero((left >= d) & (right >= SIDE - d))
                key = ahead[SIDE - d][live] ^ behind[d][live]
                o = np.argsort(key, kind="stable")
                key, ids = key[o], doc[live[o]]
                if len(key):
                    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(key))))
                    hit[live[o[ids > least]], d] = True
            edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.astype(np.int8)], axis=1), axis=1)
            row, near = np.nonzero(edge == 1)
            _, far = np.nonzero(edge == -1)
            start, end = at[row] - (far - 1), at[row] - near + LENGTH
            order = np.argsort(doc[row], kind="stable")
            yield pa.record_batch(_lists(doc[row][order], start[order], end[order], kind=pa.int32()), ["doc_id", "starts", "ends"])

        yield from _by_range(batches, close)

    return (
        docs.join(shared, "doc_id").select("doc_id", "text", "places")
        .mapInArrow(runs, "range long, n long, size long, lcp binary, rest binary, doc binary, pos binary")
        .repartition("range").sortWithinPartitions("range")
        .mapInArrow(marked, "doc_id long, starts array<int>, ends array<int>")
        .groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256."""
    spark = tx.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    ranges = _ranges(spark)
    shared = written(_shared_anchors(named, ranges), "anchors")
    marks = written(_marks(named, shared, ranges), "marks")

    def cut(batches):
        for batch in batches:
            data, off = tx.text_bytes(batch.column(1))
            removed, spans, kept = [], [], []
            for i in range(len(batch)):
                raw = data[off[i] : off[i + 1]]
                starts, ends = batch.column(2)[i], batch.column(3)[i]
                gone = np.zeros(len(raw) + 1, np.int32)
                if starts.is_valid:
                    np.add.at(gone, np.minimum(starts.values.to_numpy(), len(raw)), 1)
                    np.add.at(gone, np.minimum(ends.values.to_numpy(), len(raw)), -1)
                covered = np.cumsum(gone[:-1]) > 0
                removed.append(int(covered.sum()))
                spans.append(int(np.count_nonzero(covered[1:] & ~covered[:-1]) + (covered[:1].sum() if len(raw) else 0)))
                kept.append(raw[~covered].tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
