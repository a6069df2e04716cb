"""Exact Jaccard self-join of documents on word shingles, by a size-aware heavy-light join.

1. Every document becomes its set of shingle hashes. Equal sets are merged (128-bit signature).
2. All shingles are ordered by how often they occur: exact totals per hash bucket over all
   documents, then the hash. If two sets link, their prefixes under that order share elements.
   Buckets say less the more shingles a corpus has, so the lists are counted, shingles with a long one
   move to the end of the order, and sets with such a shingle in their prefix get a new prefix. Any
   order gives the same links; one with common shingles at its end leaves few long lists.
3. Small sets enumerate the 2-element subsets of their prefix, large sets scan the inverted lists
   of single prefix elements. The boundary is the size at which the summed cost over the corpus is
   lowest.
4. Lists of up to ``LIST_MAX`` sets give all their pairs. A longer list only pairs each set with
   the list's hub, the set whose rarest element is most common. Two sets of one list that link must share elements of their *differences* from
   the hub, or both link to it. So below each hub the rarest differences become new lists; there,
   only sets of different components pair, and only where size and place of the shared element
   leave room for enough more of them. A hub whose pairs cost less than its rows of differences gives its pairs.
5. Pairs are compared with whole sets; components of the links give the result.

No step lists all pairs of a long list, and no link between different sets is lost.

Ids are expected to be unique. Rows with the same id count as one node with several texts. A null id
gets its own row with a null component unless an equal set with an id lends it one. Null, empty and blank texts
are empty sets and link with nothing. Other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm import text as tx
from orbitsieve.llm.tables import components
from orbitsieve.scratch import written

BITS = 20
SLAB = 1 << 14
LIST_MAX = 16
#: Most shingles that are moved to the end of the order; bounds what tasks hold, not the links.
CROWDED_MOST = 1 << 20
#: Work of one compared pair, in units of one row sent to a list.
PAIR_COST = 40.0


def _sets(column, k):
    for first, last, data, off in tx.blocks(column):
        values, at = tx.block_shingles(data, off, k)
        for i in range(last - first):
            yield first + i, np.unique(values[at[i] : at[i + 1]])


def shingle_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """Occurrences (once per document) of each of 2**BITS hash buckets: a fixed 8 MB."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            parts, held = [], 0
            for _, s in _sets(batch.column(0), k):
                parts.append(s >> np.uint64(64 - BITS))
                held += len(s)
                if held > 400_000:
                    total += np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)
                    parts, held = [], 0
            if parts:
                total += np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)
        slabs = total.astype(np.uint64).reshape(-1, SLAB)
        yield pa.record_batch([pa.array(np.arange(len(slabs)), pa.int64()), tx.packed(list(slabs))], ["slab", "counts"])

    def add(batches):
        totals = {}
        for batch in batches:
            for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(counts.as_buffer(), np.uint64)
                totals[slab] = totals[slab] + counts if slab in totals else counts.copy()
        yield pa.record_batch([pa.array(list(totals), pa.int64()), tx.packed(list(totals.values()))], ["slab", "counts"])

    slabs = (
        docs.select("text").mapInArrow(count, "slab long, counts binary")
        .repartition("slab").mapInArrow(add, "slab long, counts binary").collect()
    )
    out = np.zeros(1 << BITS, np.uint64)
    for slab, counts in slabs:
        out[slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(counts, np.uint64)
    return out


def _crowded(lists: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys of long lists, sorted, and their lengths; the ``CROWDED_MOST`` longest if there are more."""
    keys = lists.groupBy("key").count().where(F.col("count") > LIST_MAX)
    found = keys.orderBy(F.desc("count"), "key").limit(CROWDED_MOST).toArrow()
    key, length = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["count"].to_numpy()
    by_key = np.argsort(key)
    return (key[by_key], length[by_key]) if len(key) else None


def _lengths(s: np.ndarray, crowded: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Length of the list of each shingle that is crowded, else 0."""
    keys, length = crowded
    maybe = np.zeros(1 << BITS, bool)
    maybe[keys >> np.uint64(64 - BITS)] = True
    v = tx.mix(s)
    out = np.zeros(len(s), np.int64)
    look = np.flatnonzero(maybe[v >> np.uint64(64 - BITS)])
    at = np.minimum(np.searchsorted(keys, v[look]), len(keys) - 1)
    out[look] = np.where(keys[at] == v[look], length[at], 0)
    return out


def _crowded_sets(column, k: int, crowded):
    """``_sets`` of the rows that have a crowded shingle, with the lengths of the lists."""
    for first, last, data, off in tx.blocks(column):
        values, at = tx.block_shingles(data, off, k)
        length = _lengths(values, crowded)
        some = np.concatenate([[0], np.cumsum(length > 0)])
        for i in np.flatnonzero(some[at[1:]] > some[at[:-1]]):
            s, of = np.unique(values[at[i] : at[i + 1]], return_index=True)
            yield first + i, s, length[at[i] : at[i + 1]][of]


def _signature(docs: DataFrame, k: int, percent: int, ranks, crowded=None) -> DataFrame:
    """Per row: hash of the text, set size, signature, its rarest elements and what scanning their lists would cost.
    With ``crowded``, which come last in the order, only rows that have one among their rarest elements without it."""

    def rows(batches):
        order = ranks.value
        usual = np.median(order)
        for batch in batches:
            n, s1, s2, keys, cost, common, kept = [], [], [], [], [], [], []
            found = _crowded_sets(batch.column(1), k, crowded.value) if crowded else _sets(batch.column(1), k)
            for row, s, *length in found:
                m = len(s)
                need = -(-percent * m // 100)
                if need == m:  # only equal sets can link
                    alone = m * (100 - percent) < percent
                else:
                    alone = False
                alone = alone or m < 2
                rank = order[s >> np.uint64(64 - BITS)]
                first = np.lexsort((s, rank))[: m - need + 2]
                if length:
                    if alone or not length[0][first].any():
                        continue
                    first = np.lexsort((s, rank, length[0]))[: m - need + 2]
                kept.append(row)
                n.append(m)
                s1.append(int(tx.mix(s).sum(dtype=np.uint64)))
                s2.append(int(tx.mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)))
                if alone:
                    keys.append(s[:0])
                    cost.append(0.0)
                    common.append(0)
                    continue
                keys.append(s[first])
                common.append(int(rank[first[0]]))
                extra = np.maximum(rank[first[: m - need + 1]].astype(float) - usual, 0)
                cost.append(float((1 + PAIR_COST * np.minimum(extra, LIST_MAX)).sum()))
            of = pa.array(kept, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(of), pa.array(n, pa.int64()), pa.array(tx.signed(np.array(s1, np.uint64))),
                 pa.array(tx.signed(np.array(s2, np.uint64))), tx.packed(keys), pa.array(cost, pa.float64()),
                 pa.array(common, pa.int64()), batch.column(2).take(of)],
                ["doc_id", "n", "s1", "s2", "keys", "cost", "common", "mark"],
            )

    kinds = "doc_id long, n long, s1 long, s2 long, keys binary, cost double, common long, mark long"
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(rows, kinds)


def boundary(sets: DataFrame) -> int:
    """Set size from which scanning lists is cheaper than enumerating 2-subsets, over all sets."""
    step = F.floor(F.log2("n") * 4)
    size = F.length("keys") / 8
    rows = (
        sets.where(F.length("keys") > 0).groupBy(step.alias("step"))
        .agg(F.max("n").alias("top"), F.sum(size * (size - 1) / 2).alias("subsets"), F.sum("cost").alias("scan"))
        .orderBy("step").collect()
    )
    best, at = math.inf, 0
    for cut in range(len(rows) + 1):
        cost = sum(r["subsets"] for r in rows[:cut]) + sum(r["scan"] for r in rows[cut:])
        if cost < best:
            best, at = cost, rows[cut - 1]["top"] + 1 if cut else 0
    return int(at)


def _keys(sets: DataFrame, small: int, percent: int, crowded=None) -> DataFrame:
    """Rows of lists; with ``crowded``, of the sets that have none of them."""

    def rows(batches):
        for batch in batches:
            if crowded:
                raw = batch.column(3)
                sizes = np.array([len(x.as_buffer()) // 8 for x in raw])
                length = _lengths(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in raw] or [np.zeros(0, np.uint64)]), crowded.value)
                some = np.concatenate([[0], np.cumsum(length > 0)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
                batch = batch.filter(pa.array(some[1:] == some[:-1]))
            keys, nodes, sizes, usual = [], [], [], []
            for node, n, common, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(raw, np.uint64)
                got = []
                if n >= small or 100 * n >= percent * small:
                    got.append(tx.mix(s[:-1]))
                if n < small:
                    i, j = np.triu_indices(len(s), 1)
                    lo, hi = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                    got.append(tx.mix(lo * np.uint64(0x9FB21C651E98DF25) + tx.mix(hi)))
                for g in got:
                    keys.append(g)
                    nodes.append(np.full(len(g), node, np.int64))
                    sizes.append(np.full(len(g), n, np.int64))
                    usual.append(np.full(len(g), -common, np.int64))
            if keys:
                yield pa.record_batch(
                    [pa.array(tx.signed(np.concatenate(keys))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(usual))],
                    ["key", "node", "n", "rare"],
                )

    return (
        sets.where(F.length("keys") > 0).select("node", "n", "common", "keys")
        .mapInArrow(rows, "key long, node long, n long, rare long")
    )


def _list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, star) of all lists; ``star`` marks a hub of a long list as a."""

    def out(a, b, star):
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), star))], ["a", "b", "star"])

    def pairs(batches):
        held, hub = [np.zeros(0, np.int64)] * 4, None  # rows of the last list; (key, node) of an open long one
        for batch in batches:
            now = [np.concatenate(x) for x in zip(held, (c.to_numpy() for c in batch.columns))]
            if hub is not None:
                same = int(np.count_nonzero(now[0] == hub[0]))
                if same:
                    yield out(np.full(same, hub[1]), now[1][:same], True)
                now = [x[same:] for x in now]
                if not len(now[0]):
                    held = now
                    continue
                hub = None
            end = int(np.flatnonzero(now[0] == now[0][-1])[0])
            yield from closed([x[:end] for x in now])
            held = [x[end:] for x in now]
            if len(held[0]) > LIST_MAX:
                hub = (held[0][0], held[1][0])
                yield out(np.full(len(held[0]) - 1, hub[1]), held[1][1:], True)
                held = [x[:0] for x in held]
        yield from closed(held)

    def closed(now):
        key, node, n, _ = now
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        for d in range(1, min(LIST_MAX, int(sizes.max()))):
            i = np.flatnonzero((size[d:] <= LIST_MAX) & (first[d:] == first[:-d]))
            i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
            if len(i):
                yield out(np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d]), False)
        j = np.flatnonzero((size > LIST_MAX) & (first != np.arange(len(key))))
        if len(j):
            yield out(node[first[j]], node[j], True)

    found = (
        rows.repartition("key").sortWithinPartitions("key", "rare", "n", "node")
        .mapInArrow(pairs, "a long, b long, star boolean")
    )
    return found.where("a <> b").groupBy("a", "b").agg(F.max("star").alias("star"))


def _difference_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their first differences from a hub."""

    def pairs(batches):
        held = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            now = [np.concatenate(x) for x in zip(held, (c.to_numpy() for c in batch.columns))]
            end = int(np.flatnonzero(now[0] == now[0][-1])[0])
            yield from closed([x[:end] for x in now])
            held = [x[end:] for x in now]
        yield from closed(held)

    def closed(now):
        key, node, n, component, size, place = now
        if len(key) < 2:
            return
        last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
        until = np.repeat(last, np.diff(np.concatenate([[-1], last])))
        live, d = np.arange(len(key)), 1
        while len(live := live[live + d <= until[live]]):  # neighbours at distance d in the same list
            i, j, d = live, live + d, d + 1
            live = live[size[j] - size[i] <= n[i] * (100 - percent) // percent + 1]  # sorted by size
            i, j = (x[component[i] != component[j]] for x in (i, j))
            most = (n[i] + n[j]) * (100 - percent) // (100 + percent)  # differences that linked sets may have
            shared = np.maximum(1, -((most - size[i] - size[j]) // 2))
            good = (np.minimum(size[i] - place[i], size[j] - place[j]) >= shared) & (
                100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            )
            i, j = i[good], j[good]
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    found = (
        rows.select("key", "node", "n", "component", "size", "place")
        .repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(pairs, "a long, b long")
    )
    return found.where("a <> b").distinct().withColumn("star", F.lit(False))


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components below each hub whose sizes and numbers of differences leave room for a link."""
    one, two = (rows.select("a", *(F.col(c).alias(f"{c}{i}") for c in ("node", "n", "size", "component"))) for i in (1, 2))
    close = (F.abs(F.col("size1") - F.col("size2")) * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)) & (
        100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    )
    found = one.join(two, "a").where((F.col("node1") < F.col("node2")) & (F.col("component1") != F.col("component2")) & close)
    return found.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.lit(False).alias("star"))


def _compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int, ranks) -> DataFrame:
    """(a, b, n, linked, size, keys): whether each pair links and, below a hub a, how many differences b
    has from it and the first of them: elements that the hub lacks, then those that b lacks, rare ones first."""

    def rows(batches):
        order = ranks.value
        for batch in batches:
            a, b, star = (batch.column(i).to_pylist() for i in range(3))
            left = [s for _, s in _sets(batch.column(3), k)]
            n, linked, size, keys = [], [], [], []
            for i, (_, y) in enumerate(_sets(batch.column(4), k)):
                x = left[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(bool(len(x) and len(y) and 100 * both >= percent * (len(x) + len(y) - both)))
                n.append(len(y))
                size.append(len(x) + len(y) - 2 * both)
                if not star[i]:
                    keys.append(y[:0])
                    continue
                diff = np.setxor1d(x, y, assume_unique=True)
                most = len(y) * (100 - percent) // percent + 1
                absent = np.isin(diff, x, assume_unique=True)
                first = np.lexsort((diff, order[diff >> np.uint64(64 - BITS)], absent))[:most]
                hub = tx.mix(np.array([a[i]], np.int64).view(np.uint64) + np.uint64(0x165667B19E3779F9))
                keys.append(tx.mix(diff[first] ^ hub))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.array(size, pa.int64()), pa.array([tx.signed(x) for x in keys], pa.list_(pa.int64()))],
                ["a", "b", "n", "linked", "size", "keys"],
            )

    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    return (
        pairs.join(texts.withColumnRenamed("text", "left"), F.col("a") == F.col("doc_id")).drop("doc_id")
        .join(texts.withColumnRenamed("text", "right"), F.col("b") == F.col("doc_id")).drop("doc_id")
        .select("a", "b", "star", "left", "right")
        .mapInArrow(rows, "a long, b long, n long, linked boolean, size long, keys array<long>")
    )


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``link_rows`` without ``mark``."""
    return link_rows(docs, k, percent).drop("mark")


def link_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, mark (xxhash64 of the text).

    Sets of ``k``-word shingles (A-Z lower-cased) link when 100 * |x & y| >= percent * |x | y|, with
    ``percent`` from 51 to 100. ``component_id`` is the smallest doc_id reachable over links.
    """
    spark = tx.small_batches(docs.sparkSession)
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranks = spark.sparkContext.broadcast(shingle_ranks(docs, k))
    rows = written(_signature(docs, k, percent, ranks), "sets")
    sets = written(
        rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "keys", "cost", "common")).alias("x"))
        .select("n", "s1", "s2", F.col("x.doc_id").alias("node"), "x.keys", "x.cost", "x.common"),
        "sets",
    )
    small, known = boundary(sets), sets.where(F.col("node").isNotNull())
    lists = _keys(known, small, percent)
    if crowded := _crowded(lists):
        crowded = spark.sparkContext.broadcast(crowded)
        same = ["node", "n", "s1", "s2"]
        moved = _signature(docs, k, percent, ranks, crowded).withColumnRenamed("doc_id", "node")
        moved = written(moved.join(known.select(same), same, "left_semi").dropDuplicates(same), "moved")
        lists = _keys(known, small, percent, crowded).union(_keys(moved, small, percent))
    found = written(_compared(written(_list_pairs(lists, percent), "pairs"), docs, k, percent, ranks), "compared")
    links = written(components(found.where("linked")), "components")
    below = (
        found.where(F.size("keys") > 0).withColumnRenamed("b", "node").join(links, "node", "left")
        .select("a", "node", "n", "size", "keys", F.coalesce("component", "node").alias("component"))
    )
    below = written(below, "below")
    # a hub whose members are one component has nothing left to link
    hubs = below.groupBy("a").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum(F.size("keys")).alias("rows")
    ).where("low <> high")
    hubs = written(hubs.select("a", (F.col("rows") < PAIR_COST / 2 * F.col("m") * (F.col("m") - 1)).alias("split")), "hubs")
    split = below.join(hubs.where("split").select("a"), "a", "left_semi").select("node", "n", "size", "component", F.posexplode("keys").alias("place", "key"))
    split = _difference_pairs(split.withColumn("place", F.col("place").cast("long")), percent)
    whole = _hub_pairs(below.join(hubs.where("not split").select("a"), "a", "left_semi"), percent)
    more = written(split.union(whole).groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    more = _compared(more, docs, k, percent, ranks).where("linked")
    edges = links.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b"))
    members = rows.join(sets.select("n", "s1", "s2", "node"), ["n", "s1", "s2"], "left")
    members = members.join(components(edges), "node", "left")
    return members.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"), "mark"
    )
