"""Merkle manifest of a table of documents, with an inclusion proof for every row.

A row's leaf is the SHA-256 of its named columns, each as ``-`` (null) or byte count, ``:`` and value. Per
language the leaves in id order form runs of eight whose digests form the next level, up to one subroot; the
subroots, in language order, form the root in the same way.

Proofs are found by pointer jumping. Each inner node starts with the digests of its siblings (one segment) and a
pointer to its parent; a self-join on the pointer appends the segments of the node pointed at and takes over
its pointer, so the distance covered doubles with each join. Leaves join their parent's finished segments last.
A pointer that spans 2**r levels is shared by at most 8**(2**r) nodes, and only the nodes above that
level are looked up, so there is no hot key that isn't in a table small enough to be broadcast.

Equal ids of a language are ordered by leaf, then by row; a null id comes first; a null language is a language of
its own, before the others. Equal rows are separate leaves. A row without an id isn't tampered with. An
empty table gives an empty manifest. Columns that aren't named don't count.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orbitsieve.llm.tables import ranked
from orbitsieve.scratch import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
UP = -1  # the tree over the subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("tree", "level", "at")
SEGMENT = "array<struct<before:binary,after:binary>>"


def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of one row's values."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def hexed(x: Column) -> Column:
    return F.lower(F.hex(x))


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: hexed(k["digest"])), "")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Runs of eight nodes (tree, at, n, digest) with their digest, and the nodes as ``kids``.

    A node that is alone in its tree keeps its digest."""
    runs = nodes.groupBy("tree", F.shiftright("at", 3).alias("at")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *more))).alias("kids")
    )
    hashed = F.unhex(F.sha2(_joined(F.col("kids")), 256))
    return runs.withColumn("digest", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(hashed))


def _members(runs: DataFrame, *more: str) -> DataFrame:
    """Runs with ``members``: their nodes, each with the segment of digests before and after it."""
    kids, none = F.col("kids"), F.array().cast(SEGMENT)

    def member(k, j):
        before = F.unhex(_joined(F.slice(kids, F.lit(1), j)))
        after = F.unhex(_joined(F.slice(kids, j + 2, F.lit(FAN))))
        path = F.when(F.col("n") > 1, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(none)
        return F.struct(*[k[c].alias(c) for c in ("at", "digest", *more)], path.alias("path"))

    return runs.select("tree", "at", F.transform("kids", member).alias("members"))


def _segments(runs: DataFrame, *more: str) -> DataFrame:
    """(tree, run, kid): each node of the runs with its segment ``kid.path``."""
    return _members(runs, *more).select("tree", F.col("at").alias("run"), F.explode("members").alias("kid"))


def _above(runs: DataFrame) -> DataFrame:
    return runs.select("tree", "at", F.floor((F.col("n") + FAN - 1) / FAN).cast("long").alias("n"), "digest")


def _node(tree, level, at, path, up_tree, up_level, up_at, subroot) -> list[Column]:
    return [
        tree.cast("long").alias("tree"), level.cast("int").alias("level"), at.cast("long").alias("at"), path.alias("path"),
        up_tree.cast("long").alias("up_tree"), up_level.cast("int").alias("up_level"), up_at.cast("long").alias("up_at"),
        subroot.cast("binary").alias("subroot"),
    ]


def _climb(first: DataFrame, widest: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """From the runs over the leaves up: rows of inner nodes below the top, tops (tree, level, digest), height."""
    nodes, tops, now, level, widest = [], [], _above(first), 1, -(-widest // FAN)
    none = F.lit(None)
    while True:
        tops.append(now.where("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
        if widest <= 1:
            return nodes, tops, level
        runs = written(_runs(now.where("n > 1")), "runs")
        nodes.append(
            _segments(runs).select(
                *_node(F.col("tree"), F.lit(level), F.col("kid.at"), F.col("kid.path"), F.col("tree"), F.lit(level + 1), F.col("run"), none)
            )
        )
        now, level, widest = _above(runs), level + 1, -(-widest // FAN)


def _jump(nodes: DataFrame, height: int) -> DataFrame:
    """All nodes with the segments up to the root and the subroot on the way, by pointer doubling."""
    done, reach = [], 1
    while reach < height:
        far = reduce(DataFrame.union, done, nodes).where((F.col("level") > reach) | (F.col("tree") == UP))
        far = far.select(*[F.col(c).alias("_" + c) for c in nodes.columns])
        # finished nodes would all meet under one null key
        done.append(nodes.where("up_tree is null"))
        there = [F.col("up_" + c) == F.col("_" + c) for c in KEY]
        nodes = written(
            nodes.where("up_tree is not null").join(far, reduce(lambda a, b: a & b, there)).select(
                *_node(
                    F.col("tree"), F.col("level"), F.col("at"), F.concat("path", "_path"),
                    F.col("_up_tree"), F.col("_up_level"), F.col("_up_at"), F.coalesce("subroot", "_subroot"),
                )
            ),
            "jumped",
        )
        reach *= 2
    return reduce(DataFrame.union, done, nodes)


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    ``proof`` lists the siblings' digests of each level (before and after the node). ``folded_root`` is
    computed from the proof and the leaf, where ``tampered`` holds from the leaf with the text ``changed``.
    """
    text = F.col("text").cast("string")
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    values = [F.col(c) for c in FIELDS]
    forged = leaf_digest(values[:-1] + [text if changed is None else changed])
    leaves = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
            F.unhex(leaf_digest(values)).alias("digest"), F.when(tampered, F.unhex(forged)).alias("forged"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    placed = ranked(leaves, ["lang", "doc_id", "digest", "row"], "lang")
    sizes = placed.sizes
    langs = ranked(sizes.select("lang").distinct(), ["lang"]).rows.select(F.col("lang").alias("_lang"), F.col("at").alias("tree"))
    trees, widest = langs.count(), sizes.agg(F.max("n")).first()[0] or 0
    sizes = written(sizes.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang"), "sizes")
    first = written(_runs(placed.joined(sizes), "doc_id", "forged"), "runs")
    nodes, tops, height = _climb(first, widest)

    subroots = reduce(DataFrame.union, tops).select(
        F.lit(UP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), "digest", "level"
    )
    upper = written(_runs(subroots, "level"), "runs")
    more, top, up_height = _climb(upper, trees)
    ends = F.lit(trees) <= 1
    none = F.lit(None)
    links = _segments(upper, "level").select(
        *_node(
            F.col("kid.at"), F.col("kid.level"), F.lit(0), F.col("kid.path"), F.when(~ends, F.lit(UP)), F.when(~ends, F.lit(1)),
            F.when(~ends, F.col("run")), F.col("kid.digest"),
        )
    )
    peak = reduce(DataFrame.union, top)
    crown = peak.where(~ends).select(*_node(F.lit(UP), F.col("level"), F.lit(0), F.array().cast(SEGMENT), none, none, none, none))
    table = written(reduce(DataFrame.union, nodes + more, links).union(crown), "nodes")
    paths = _jump(table, height + up_height).where((F.col("level") == 1) & (F.col("tree") != UP))
    root = peak.select(hexed(F.col("digest"))).first()
    root = F.lit(root[0] if root else None).cast("string")

    own = paths.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("rest"), "subroot")
    here = _members(first, "doc_id", "forged").join(own, (F.col("tree") == F.col("_tree")) & (F.col("at") == F.col("_at")))
    rows = here.select("subroot", "rest", F.explode("members").alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), F.coalesce("m.forged", "m.digest").alias("start"),
        F.concat("m.path", "rest").alias("proof"), hexed(F.col("subroot")).alias("subroot"),
    )
    siblings = F.array_join(F.transform("proof", lambda s: hexed(F.concat(s["before"], s["after"]))), "")
    fold = F.aggregate(
        "proof", hexed(F.col("start")), lambda x, s: F.sha2(F.concat(hexed(s["before"]), x, hexed(s["after"])), 256)
    )
    return rows.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        fold.alias("folded_root"), "proof",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_third(docs: DataFrame) -> DataFrame:
    """The manifest checked against texts of which a third (by CRC of the id) lost their capitals."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, hit, F.translate(F.col("text").cast("string"), UPPER, LOWER))
