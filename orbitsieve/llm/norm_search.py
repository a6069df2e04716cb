"""Ranked lexical search by norm buckets (after LEMP).

Scores are sums over a query's terms of weight times impact, both integers. A document is the vector of its
impacts, a query the vector of its term counts, each scaled by the square root of the term's weight, so that
the score is their inner product. Documents are laid out by descending length of these vectors. The longest
1/64 give every query a threshold; whatever is shorter than the least threshold divided by the query's length
isn't read again. The others go in buckets of similar length: the Cauchy-Schwarz inequality drops
whole buckets for a query, then each document by its coordinates on the query's FOCUS largest terms and the
length of the rest. What is left is scored in 64-bit integers, and thresholds rise as a task goes on.

Queries are the distinct texts of the items, in blocks of bounded size (only these are sent to tasks);
items with the same text get the same rows each, items without text or terms none. Documents that repeat an id
are ranked one by one; a null id comes before others of the same score. Null texts have no terms. An
empty table on either side gives no rows. Other columns are ignored.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from orbitsieve.llm import text as tx
from orbitsieve.scratch import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = {i: i + 32 for i in range(65, 91)}
APART = np.zeros(256, dtype=bool)  # bytes that no term has
APART[:0x30] = APART[0x3A:0x41] = APART[0x5B:0x61] = APART[0x7B:0x80] = True
TOP = 10
FOCUS = 8
ITEMS, ITEM_BYTES = 4096, 8 << 20  # of a block of queries
CELLS = 1 << 21  # of a bucket's matrix
SLACK = 1 + 1e-9  # bounds are computed in doubles
WORDS = 8  # terms of up to this many 8-byte words are matched as arrays
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


class Vocabulary:
    """Looks up byte strings among the terms of a block of queries, exactly."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        raw = [t.encode() for t in terms]
        self.tables, self.long = {}, {b: i for i, b in enumerate(raw) if len(b) > 8 * WORDS}
        self.lengths = np.array(sorted({len(b) for b in self.long}), np.int64)
        for c in range(1, WORDS + 1):
            own = [i for i, b in enumerate(raw) if (len(b) + 7) // 8 == c]
            if not own:
                continue
            words = np.array([np.frombuffer(raw[i].ljust(8 * c, b"\0"), "<u8") for i in own])
            seed = 0
            while len(set(keys := self._keys(words.T, seed).tolist())) < len(own):
                seed += 1
            order = np.argsort(np.array(keys, np.uint64))
            self.tables[c] = (seed, np.array(keys, np.uint64)[order], words[order], np.array(own)[order])

    @staticmethod
    def _keys(words, seed: int) -> np.ndarray:
        key = words[0]
        for w in words[1:]:
            key = tx.mix(key + np.uint64(seed)) + w
        return key

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and which terms they are."""
        size = ends - starts
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8 * WORDS, np.uint8)]), 8)
        spans, ids = [], []
        for c, (seed, keys, table, own) in self.tables.items():
            of = np.flatnonzero((size + 7) // 8 == c)
            words = [np.ascontiguousarray(view[starts[of] + 8 * j]).view("<u8").ravel() for j in range(c)]
            words[-1] = words[-1] & MASKS[size[of] - 8 * (c - 1)]
            key = self._keys(words, seed)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            for j, w in enumerate(words):
                hit &= table[at, j] == w
            spans.append(of[hit])
            ids.append(own[at[hit]])
        for i in np.flatnonzero(np.isin(size, self.lengths)):
            found = self.long.get(data[starts[i] : ends[i]].tobytes())
            if found is not None:
                spans.append(np.array([i]))
                ids.append(np.array([found]))
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(spans), np.concatenate(ids)


def _query_blocks(items: DataFrame):
    """Lists of distinct item texts, each list of bounded size."""
    texts = items.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    k, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(-(-k // ITEMS), -(-(size or 0) // ITEM_BYTES))
    for p in range(parts):
        yield [r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect()]


def _counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Number of terms of each document and its counts of the vocabulary's terms, as packed arrays."""

    def run(batches):
        for batch in batches:
            for first, last, data, off in tx.blocks(batch.column(1)):
                data = tx.LOWER[data]
                starts, ends, tokens = tx.word_spans(data, off, APART)
                spans, ids = vocabulary.match(data, starts, ends)
                doc = np.searchsorted(tokens, spans, side="right") - 1
                pair, tf = np.unique(doc * np.int64(vocabulary.size) + ids, return_counts=True)
                cut = np.searchsorted(pair, np.arange(1, last - first) * np.int64(vocabulary.size))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first), pa.array(np.diff(tokens)),
                        tx.packed(np.split((pair % vocabulary.size).astype("<i4"), cut)), tx.packed(np.split(tf.astype("<i4"), cut)),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary").where("n > 0")


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit values of a column of packed arrays, and the offset of each row in them."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].tobytes() if raw is not None else b""
    return np.frombuffer(values, "<i4").astype(np.int64), (off - off[0]) // 4


def _document_counts(counted: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0))[0], minlength=size)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for term, k in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = k
    return df


def _vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Impacts and length of each document that has any term of a query."""
    roots = np.sqrt(weights.astype(float))

    def run(batches):
        for batch in batches:
            terms, off = _values(batch.column(2))
            tf = _values(batch.column(3))[0]
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(m)), np.diff(off))
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            norm = np.sqrt(np.bincount(row, (impact * roots[terms]) ** 2, minlength=len(m)))
            yield pa.record_batch(
                [batch.column(0), pa.array(norm), batch.column(2), tx.packed(np.split(impact.astype("<i4"), off[1:-1]))],
                ["doc_id", "norm", "terms", "impacts"],
            )

    return counted.where("octet_length(terms) > 0").mapInArrow(run, "doc_id long, norm double, terms binary, impacts binary").where("norm > 0")


class _Queries:
    """Terms, integer weights and bounds of a block of queries."""

    def __init__(self, bags: list[Counter], places: dict[str, int], weights: np.ndarray):
        roots = np.sqrt(weights.astype(float))
        self.terms, self.gains, self.focus, self.pull, self.rest, self.norm = [], [], [], [], [], []
        for bag in bags:
            terms = np.array([places[t] for t in bag], np.int64)
            counts = np.array(list(bag.values()), np.int64)
            length = counts * roots[terms]
            first = np.argsort(-length, kind="stable")
            self.terms.append(terms)
            self.gains.append(counts * weights[terms])
            self.focus.append(terms[first[:FOCUS]])
            self.pull.append(length[first[:FOCUS]])
            self.rest.append(math.sqrt(float((length[first[FOCUS:]] ** 2).sum())))
            self.norm.append(math.sqrt(float((length**2).sum())))
        self.norm = np.array(self.norm)
        self.roots = roots


class _Best:
    """The best rows of each query so far, and the score that a row needs to matter."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, none) for _ in least]

    def add(self, q: int, scores, known, ids):
        scores, known, ids = (np.concatenate([a, b]) for a, b in zip(self.rows[q], (scores, known, ids)))
        first = np.lexsort((ids, known, -scores))[:TOP]
        self.rows[q] = (scores[first], known[first], ids[first])
        if len(first) == TOP:
            self.least[q] = max(self.least[q], scores[first[-1]])


def _bucket(queries: _Queries, best: _Best, ids, known, norms, terms, impacts, off):
    """Score a bucket of documents (one run of vectors) for every query that it can matter to."""
    alive = np.flatnonzero(queries.norm * (norms.max() * SLACK) >= np.maximum(best.least, 1))
    if not len(alive):
        return
    used, column = np.unique(terms, return_inverse=True)
    exact = np.zeros((len(norms), len(used) + 1), np.int64)
    exact[np.repeat(np.arange(len(norms)), np.diff(off)), column] = impacts
    scaled = exact * np.append(queries.roots[used], 0.0)
    place = np.full(len(queries.roots), len(used))
    place[used] = np.arange(len(used))
    squares = norms * norms
    for q in alive:
        part = scaled[:, place[queries.focus[q]]]
        rest = np.sqrt(np.maximum(squares - (part * part).sum(1), 0))
        bound = (part @ queries.pull[q] + queries.rest[q] * rest) * SLACK
        rows = np.flatnonzero(bound >= max(best.least[q], 1))
        if not len(rows):
            continue
        scores = exact[rows[:, None], place[queries.terms[q]][None]] @ queries.gains[q]
        good = scores >= max(best.least[q], 1)
        if good.any():
            rows = rows[good]
            best.add(q, scores[good], known[rows], ids[rows])


def _search(vectors: DataFrame, queries: _Queries, least: np.ndarray) -> DataFrame:
    """(query, doc_id, score): at least the best rows, at most TOP for each query and task."""
    height = max(16, min(512, CELLS // (len(queries.roots) + 1)))

    def run(batches):
        best = _Best(least)
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid()).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            norms = batch.column(1).to_numpy()
            terms, off = _values(batch.column(2))
            impacts = _values(batch.column(3))[0]
            for a in range(0, len(norms), height):
                b = min(a + height, len(norms))
                span = slice(off[a], off[b])
                _bucket(queries, best, ids[a:b], known[a:b], norms[a:b], terms[span], impacts[span], off[a : b + 1] - off[a])
        found = [(q, k, i, s) for q, rows in enumerate(best.rows) for s, k, i in zip(*(x.tolist() for x in rows))]
        q, k, i, s = zip(*found) if found else ((), (), (), ())
        yield pa.record_batch(
            [pa.array(q, pa.int32()), pa.array([x if y else None for x, y in zip(i, k)], pa.int64()), pa.array(s, pa.int64())],
            ["query", "doc_id", "score"],
        )

    return vectors.mapInArrow(run, "query int, doc_id long, score long")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _block_results(docs: DataFrame, texts: list[str]) -> DataFrame | None:
    bags = [Counter(TERM.findall(t.translate(LOWERED))) for t in texts]
    places = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
    if not places:
        return None
    counted = written(_counted(docs, Vocabulary(list(places))), "counted")
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = _document_counts(counted, len(places))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
    queries = _Queries(bags, places, weights)

    # equal lengths (copies) are spread by row
    laid = _vectors(counted, weights, n_docs, n_terms).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("norm"), "row"]
    vectors = written(laid.repartitionByRange(*order).sortWithinPartitions(*order).drop("row"), "vectors")
    cut = vectors.agg(F.percentile_approx("norm", 63 / 64)).first()[0]
    if cut is None:
        return None
    zero = np.zeros(len(texts), np.int64)
    seeds = written(_ranked(_search(vectors.where(F.col("norm") >= cut), queries, zero)), "seeds")
    least = zero.copy()
    for q, score in seeds.where(F.col("rank") == TOP).select("query", "score").collect():
        least[q] = score
    need = float((least / np.maximum(queries.norm, 1e-300)).min()) / SLACK
    rest = _search(vectors.where((F.col("norm") < cut) & (F.col("norm") >= need)), queries, least)
    return _ranked(seeds.drop("rank").union(rest))


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    out = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    for texts in _query_blocks(items):
        found = _block_results(docs, texts)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
            rows = written(found, "found").join(names, "query").select("text", "rank", "doc_id", "score")
            out = out.union(asked.join(rows, "text").select("item_id", "rank", "doc_id", "score"))
    return out
