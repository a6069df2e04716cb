"""Row filters, labels and splits. All row-local: no shuffle, predicates reach the scan."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import groups as G


def cut_magnitude(df: DataFrame, target: str = "under", threshold: float = K.HAZARD_H) -> DataFrame:
    h = F.col("h")
    return df.filter(h < threshold if target == "under" else h >= threshold)


def get_neas(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.filter(F.col("neo") == "Y").dropna(subset=subset)


def atiras(df: DataFrame) -> DataFrame:
    return df.filter(G.is_atira())


def atens(df: DataFrame) -> DataFrame:
    return df.filter(G.is_aten())


def apollos(df: DataFrame) -> DataFrame:
    return df.filter(G.is_apollo())


def amors(df: DataFrame) -> DataFrame:
    return df.filter(G.is_amor())


def group_tags(df: DataFrame) -> DataFrame:
    """One row per (orbit, group); an orbit on a border appears once for each of its groups."""
    return df.withColumn("grp", F.explode(G.group_slots())).filter(F.col("grp").isNotNull())


def labelled(df: DataFrame, rule: Column) -> DataFrame:
    """Add ``label`` by one of the three hazard rules; rows the rule cannot decide are in no class."""
    return df.withColumn("label", rule.cast("int")).filter(F.col("label").isNotNull())


def haz_by_flag(df: DataFrame) -> DataFrame:
    return labelled(df, G.label_by_flag())


def haz_by_h(df: DataFrame) -> DataFrame:
    return labelled(df, G.label_by_h())


def haz_by_moid(df: DataFrame) -> DataFrame:
    return labelled(df, G.label_by_moid())


def cutoff_outliers(df: DataFrame) -> DataFrame:
    return df.filter((F.col("a") < K.OUTLIER_A) & (F.col("i") < K.OUTLIER_I))


def split_by_colval(df: DataFrame, col: str, value: float) -> DataFrame:
    """Add ``side``: 'left' up to and including the value, 'right' above it."""
    c = F.col(col)
    return df.withColumn("side", F.when(c <= value, "left").when(c > value, "right"))


def side_of_line(p1, p2, x: str, y: str) -> Column:
    """Side of the line p1 -> p2 a point (x, y) lies on; points on the line are 'left'."""
    (x1, y1), (x2, y2) = sorted([tuple(p1), tuple(p2)], key=lambda p: p[0])
    if x1 == x2:
        (x1, y1), (x2, y2) = tuple(p1), tuple(p2)
    cross = -(y2 - y1) * (F.col(x) - x1) + (x2 - x1) * (F.col(y) - y1)
    return F.when(cross <= 0, "left").when(cross > 0, "right")


def split_by_line(df: DataFrame, p1, p2, x: str, y: str) -> DataFrame:
    return df.withColumn("side", side_of_line(p1, p2, x, y))


def side_purity(df: DataFrame) -> DataFrame:
    """Hazardous and other rows of each side, and the hazardous share."""
    n1, n0 = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.groupBy("side").agg(
        n1.alias("n_pha"), n0.alias("n_nha"), F.try_divide(n1, n1 + n0).alias("purity")
    )


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("label", *cols)


def box_filter(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside the closed [min, max] of every column."""
    return df.filter(reduce(and_, [F.col(c).between(lo, hi) for c, (lo, hi) in scales.items()]))


def minigroups(
    df: DataFrame, col: str, levels: list[float], lo_factor: float = 0.001, hi_factor: float = 1.001
) -> DataFrame:
    """Add ``minigroup``: the first slice of consecutive levels that holds the value."""
    v = F.col(col)
    slices = [
        F.when((v > lo * lo_factor) & (v <= hi * hi_factor), F.lit(k))
        for k, (lo, hi) in enumerate(zip(levels, levels[1:]))
    ]
    return df.withColumn("minigroup", F.coalesce(*slices)).filter(F.col("minigroup").isNotNull())


def domain_split(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Add ``domain``: number (from 1) of the first rule that holds, NULL if none does."""
    return df.withColumn("domain", F.coalesce(*[F.when(r, F.lit(k)) for k, r in enumerate(rules, 1)]))


def in_domain(k: int) -> Column:
    """1 for the rows of domain ``k``, 0 for its complement."""
    return F.col("domain").eqNullSafe(k).cast("int")
