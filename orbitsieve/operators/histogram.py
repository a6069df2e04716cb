"""Histograms: one pass, counted before the shuffle, so the shuffle holds at most one row per bin."""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from .scaling import bounds, unit


MOST_BINS = 10_000_000


def hist_table(df: DataFrame, cols: list[str], n: int = 50) -> DataFrame:
    """Density histograms of several columns: rows (name, bin, center, width, density).

    Bins run from 0 to the maximum; their number stretches ``n`` by max / (max - min), MOST_BINS at most.
    """
    lim = bounds(df, cols)
    parts, frames = [], []
    for c in cols:
        lo, hi = lim[c]
        if lo is None or not 0 < hi > lo:
            raise ValueError(f"column {c} needs different values up to a positive maximum")
        nb = int(hi * n / (hi - lo)) - 1
        if nb < 1:
            raise ValueError(f"column {c} reaches so far below 0 that {n} leaves no bin above it")
        if nb > MOST_BINS:
            raise ValueError(f"column {c} would have {nb} bins; shift it towards 0 or take fewer than {n}")
        width = hi / nb
        slot = F.least(F.floor(F.col(c) / width), F.lit(nb - 1)).cast("int")
        parts.append(F.when(F.col(c) >= 0, F.struct(F.lit(c).alias("name"), slot.alias("bin"))))
        frames.append((c, nb, width))
    counted = (
        df.select(F.explode(F.array(*parts)).alias("s"))
        .filter(F.col("s").isNotNull())
        .groupBy("s.name", "s.bin")
        .agg(F.count("*").alias("n"))
    )
    # From here on at most one row per bin.
    spark = df.sparkSession
    all_bins = reduce(
        DataFrame.unionByName,
        [spark.range(nb).select(F.lit(c).alias("name"), F.lit(width).alias("width"), F.col("id").cast("int").alias("bin")) for c, nb, width in frames],
    )
    totals = counted.groupBy("name").agg(F.sum("n").alias("total"))
    return (
        all_bins.join(counted, ["name", "bin"], "left")
        .join(totals, "name")
        .select(
            "name",
            "bin",
            ((F.col("bin") + 0.5) * F.col("width")).alias("center"),
            "width",
            (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"),
        )
    )


def hist_density(df: DataFrame, col: str, n: int = 50) -> DataFrame:
    """Density histogram of one column."""
    return hist_table(df, [col], n).drop("name")


def pair_distribution(
    df: DataFrame, cols: tuple[str, ...] = K.PAIR_COLUMNS, bins: int = 50
) -> DataFrame:
    """Counts per (pair of columns, class, cell) of a bins x bins mesh with common limits."""
    cols = list(cols)
    lim = bounds(df, cols)
    slot = {
        c: F.least(F.floor(unit(c, *lim[c]) * bins), F.lit(bins - 1)).cast("int") for c in cols
    }
    pairs = list(combinations(cols, 2))
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("p"), slot[x].alias("xbin"), slot[y].alias("ybin"))
            for k, (x, y) in enumerate(pairs)
        ]
    )
    counted = (
        df.select("label", F.explode(cells).alias("s"))
        .groupBy("s.p", "label", "s.xbin", "s.ybin")
        .agg(F.count("*").alias("n"))
    )
    # Names only after counting, so that rows are grouped by small integers.
    names = F.array(*[F.lit(f"{x}-{y}") for x, y in pairs])
    return counted.select(F.get(names, F.col("p")).alias("pair"), "label", "xbin", "ybin", "n")
