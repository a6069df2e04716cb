"""Connected components and small helpers on tables of ids."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from orbitsieve.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected ``edges`` (a, b); component is the smallest.

    Alternating large-star and small-star steps on written tables; a hub's neighbours are only ever
    reduced to a minimum and joined, never gathered. Nulls and self-links are ignored.
    """
    now = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


@dataclass(frozen=True)
class Ranked:
    """Rows laid out in order, and one row per task and group: ``first``, ``before`` and group size ``n``."""

    laid: DataFrame
    sizes: DataFrame
    group: str | None

    def joined(self, sizes: DataFrame) -> DataFrame:
        """All rows with ``at`` (from 0, within the group) and the further columns of ``sizes``."""
        marks = sizes.withColumnsRenamed({c: "_" + c for c in ("pid", self.group) if c})
        here = F.shiftright("mark", 33) == F.col("_pid")
        if self.group:
            here = here & F.col(self.group).eqNullSafe(F.col("_" + self.group))
        rows = self.laid.join(marks, here).withColumn("at", F.col("before") + F.col("mark") - F.col("first"))
        return rows.drop("mark", "first", "before", *[c for c in marks.columns if c.startswith("_")])

    @property
    def rows(self) -> DataFrame:
        return self.joined(self.sizes)


def ranked(df: DataFrame, keys: list[str], group: str | None = None) -> Ranked:
    """Number the rows by ``keys`` (whose first is ``group``, if any) without a window over all of them.

    Rows are sorted over ranges of keys and written; rows are then counted per range and group, and only
    these counts go through windows. A range joins its own counts, so no group is ever a hot key.
    """
    order = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = written(order.withColumn("mark", F.monotonically_increasing_id()), "laid")
    by = [group] if group else []
    runs = laid.groupBy(F.shiftright("mark", 33).alias("pid"), *by).agg(F.count("*").alias("k"), F.min("mark").alias("first"))
    whole = Window.partitionBy(*by)
    so_far = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.select(
        "pid", *by, "first", F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n")
    )
    return Ranked(laid, written(sizes, "sizes"), group)
