"""Document fingerprints by winnowing.

Each run of GRAM code points has a rolling hash. Of every WINDOW consecutive hashes the least is chosen, the
rightmost if there are several, and kept with its position. So two texts that share GRAM + WINDOW - 1 = 79
code points anywhere share a fingerprint, whose positions say where, and no shared run shorter than GRAM ever counts.
A text shorter than GRAM counts as one gram, one with fewer than WINDOW grams as one window; null counts as
empty, which has no fingerprint. Long texts are read in overlapping pieces, with the same result.

``compare_edits`` needs each document together with the next one in id order. Ranges of ids are counted
first, from ids and text hashes alone; then each text moves once, to the task of its range, and the first of a
range also to the range before it. Documents with the same id are ordered by text hash and text; a null id
comes last in descending order. Rows that agree in id and text stay in one range.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orbitsieve.llm import text as tx

GRAM, WINDOW = 16, 64
BASE = 0x1C6EF372FE94F82B
FINAL = 0x2545F4914F6CDD1D
PIECE = 1 << 20
NEVER = np.uint64(2**64 - 1)
MARKS = "array<struct<hash:bigint,pos:int>>"
ARROW_MARKS = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _ahead(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    out[: max(len(x) - by, 0)] = x[by:]
    return out


def _gram_hashes(units: np.ndarray) -> np.ndarray:
    """48-bit hash of the GRAM units from each place on."""
    power, part, done, out = BASE, units, 0, None
    size = 1
    while True:
        if GRAM & size:
            out = part if out is None else out * np.uint64(power) + _ahead(part, done, 0)
            done += size
        size *= 2
        if size > GRAM:
            return (out * np.uint64(FINAL)) >> np.uint64(16)
        part = part * np.uint64(power) + _ahead(part, size // 2, 0)
        power = power * power % 2**64


def _least(values: np.ndarray) -> np.ndarray:
    """Place of the least value of each window, the rightmost of equal ones."""
    best, place, reach = values.copy(), np.arange(len(values)), 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        right, there = _ahead(best, step, NEVER), _ahead(place, step, 0)
        take = (right <= best) & (right != NEVER)
        np.copyto(best, right, where=take)
        np.copyto(place, there, where=take)
        reach += step
    return place


def _block(pieces: list[tuple[int, int, np.ndarray]]):
    """Text number, position and hash of the marks of pieces (text number, first place, code points)."""
    gap = np.zeros(GRAM + WINDOW, np.uint64)
    flat = np.concatenate([x for _, _, u in pieces for x in (u.astype(np.uint64) + np.uint64(1), gap)])
    sizes = np.array([len(u) for _, _, u in pieces])
    at = np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
    grams = np.maximum(sizes - GRAM + 1, 1)
    place = np.arange(len(flat)) - np.repeat(at, sizes + len(gap))
    hashes = _gram_hashes(flat)
    hashes[place >= np.repeat(grams, sizes + len(gap))] = NEVER
    chosen = _least(hashes)[place < np.repeat(np.maximum(grams - WINDOW + 1, 1), sizes + len(gap))]
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    piece = np.searchsorted(at, chosen, side="right") - 1
    number, first = (np.array([p[j] for p in pieces]) for j in (0, 1))
    return number[piece], chosen - at[piece] + first[piece], hashes[chosen]


def winnow(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of all marks of texts (code points), and the offset of each text in them."""
    found, pieces, held = [], [], 0
    for number, units in enumerate(texts):
        windows = max(len(units) - GRAM - WINDOW + 2, 1) if len(units) else 0
        for a in range(0, windows, PIECE):
            part = units[a : a + PIECE + GRAM + WINDOW - 2]
            pieces.append((number, a, part))
            held += len(part)
            if held >= PIECE:
                found.append(_block(pieces))
                pieces, held = [], 0
    if pieces:
        found.append(_block(pieces))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    number, pos, hashes = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(pos), bool)  # pieces overlap: a mark may be chosen by both
    new[1:] = (number[1:] != number[:-1]) | (pos[1:] != pos[:-1])
    number, pos, hashes = number[new], pos[new], hashes[new]
    return hashes, pos, np.searchsorted(number, np.arange(len(texts) + 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(marks) -> list[np.ndarray]:
    hashes, _, off = marks
    return [np.unique(hashes[a:b]) for a, b in zip(off[:-1], off[1:])]


def _listed(marks) -> pa.Array:
    hashes, pos, off = marks
    pairs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(pos.astype(np.int32))], fields=list(ARROW_MARKS.value_type))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pairs)


def _runs(batches, limit: int = 4 << 20):
    """Parts of Arrow batches with texts (the last column) of about ``limit`` bytes."""
    for batch in batches:
        for first, last, _, _ in tx.blocks(batch.column(batch.num_columns - 1), limit):
            yield batch.slice(first, last - first)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, marks) of every document; a map over the texts."""

    def run(batches):
        for part in _runs(batches):
            texts = [code_points(t or "") for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), _listed(winnow(texts))], ["doc_id", "n_chars", "marks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_chars long, marks {MARKS}")


def _heads(docs: DataFrame, ranges: int) -> list[tuple]:
    """The greatest (id, text hash) of each range of about as many documents, descending."""
    spread = docs.select("doc_id", "h").repartitionByRange(ranges, F.desc("doc_id"), F.desc("h"))
    rows = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("doc_id", "h")).alias("m")).select("m.*").collect()
    return sorted((tuple(r) for r in rows), key=lambda k: (k[0] is not None, k[0] or 0, k[1]), reverse=True)


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows with their range, descending, and the first row of each range also at the end of the one before.

    The heads are at most ``ranges`` literals, looked up in two steps."""
    heads = _heads(docs, ranges)
    if not heads:
        return docs.select(F.lit(0).alias("range"), F.lit(False).alias("more"), "*")
    step = math.isqrt(len(heads)) + 1
    pair = lambda k: F.struct(F.lit(k[0]).cast("long").alias("doc_id"), F.lit(k[1]).cast("long").alias("h"))
    key = F.struct("doc_id", "h")
    blocks = F.array(*[F.array(*[pair(k) for k in heads[a : a + step]]) for a in range(0, len(heads), step)])
    before = lambda keys, of=lambda x: x: F.size(F.filter(keys, lambda x: of(x) >= key)) - 1
    major = before(blocks, lambda x: F.get(x, F.lit(0)))
    found = docs.withColumn("major", major).withColumn("minor", before(F.get(blocks, F.col("major"))))
    here = F.col("major") * step + F.col("minor")
    is_head = F.get(F.get(blocks, F.col("major")), F.col("minor")) == key
    place = lambda r, more: F.struct(r.cast("int").alias("range"), F.lit(more).alias("more"))
    places = F.when(is_head, F.array(place(here, False), place(F.pmod(here - 1, F.lit(len(heads))), True))).otherwise(F.array(place(here, False)))
    return found.select(F.explode(places).alias("place"), *docs.columns).select("place.*", *docs.columns)


def compare_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every document against an edited copy and against the next document (descending id; after the last the first).

    The copy's last floor(n_chars / 2) code points are replaced by the first as many of the next document,
    or all it has. Returns doc_id, n_chars, edited_sha256, marks, edited_marks, near_edited, near_next.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    placed = _in_ranges(rows, ranges)
    order = ["range", "more", F.desc("doc_id"), F.desc("h"), F.desc("text")]
    laid = placed.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order).select("range", "more", "doc_id", "text")

    def run(batches):
        last = None  # a document that still waits for its next one
        for part in _runs(batches):
            spans, more, ids, texts = (part.column(j).to_pylist() for j in range(4))
            own = winnow([code_points(t) for t in texts])
            own_sets = _sets(own)
            todo = list(zip(spans, ids, texts, own_sets, range(len(ids))))
            listed = _listed(own)
            if last is not None:
                todo.insert(0, (*last[:4], -1))
            pairs = [(x, y) for x, y in zip(todo, todo[1:]) if x[0] == y[0] and not (x[4] >= 0 and more[x[4]])]
            marks = pa.concat_arrays([last[4], listed.take(pa.array([x[4] for x, _ in pairs if x[4] >= 0], pa.int64()))]) if pairs and pairs[0][0][4] < 0 else listed.take(pa.array([x[4] for x, _ in pairs], pa.int64()))
            last = None if more[-1] else (*todo[-1][:4], listed.take(pa.array([len(ids) - 1])))
            edited = []
            for x, y in pairs:
                half = len(x[2]) // 2
                edited.append(x[2][: len(x[2]) - half] + y[2][:half])
            other = winnow([code_points(t) for t in edited])
            yield pa.record_batch(
                [
                    pa.array([x[1] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    marks,
                    _listed(other),
                    pa.array([likeness(x[3], s) for (x, _), s in zip(pairs, _sets(other))], pa.float64()),
                    pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "marks", "edited_marks", "near_edited", "near_next"],
            )

    return laid.mapInArrow(
        run, f"doc_id long, n_chars long, edited_sha256 string, marks {MARKS}, edited_marks {MARKS}, near_edited double, near_next double"
    )


def as_text(marks: Column) -> Column:
    """Marks as ``hash:position``, the hash in hex, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(m["hash"])), F.lit(":"), m["pos"].cast("string"))), ",")
