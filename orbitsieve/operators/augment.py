"""Unions and mirrored copies.

Each orbit emits its copies by ``explode`` of a short array: one scan, no self-union, no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups as G
from .scaling import bounds


def _copies(df: DataFrame, col: str, values: Column) -> DataFrame:
    return df.select(*[F.explode(values).alias(col) if c == col else F.col(c) for c in df.columns])


def union_groups(df: DataFrame) -> DataFrame:
    """Bag union of Atiras and Atens: an orbit on their border appears twice. One scan."""
    tags = F.array(F.when(G.is_atira(), 1), F.when(G.is_aten(), 2))
    return df.withColumn("_tag", F.explode(tags)).filter("_tag is not null").drop("_tag")


def mirror(df: DataFrame, col: str, v: float) -> DataFrame:
    """Rows and their mirror images over ``v``."""
    x = F.col(col)
    return _copies(df, col, F.array(x, 2 * v - x))


def double_mirror(df: DataFrame, col: str, v: float, strict: bool = False) -> DataFrame:
    """Rows mirrored over ``v`` and over the middle of their own half: four copies of each.

    ``strict`` puts x == v into the upper half.
    """
    x = F.col(col)
    lower = x < v if strict else x <= v
    own_half = F.when(lower, v - x).otherwise(3 * v - x)
    opposite = F.when(lower, v + x).otherwise(x - v)
    return _copies(df, col, F.array(x, own_half, 2 * v - x, opposite))


def shift_mirror(df: DataFrame, col: str, v: float) -> DataFrame:
    """Rows, their halves exchanged, and their mirror images over ``v``."""
    x = F.col(col)
    return _copies(df, col, F.array(x, F.when(x <= v, x + v).otherwise(x - v), 2 * v - x))


def extend_copies(df: DataFrame, col: str, factor: float = 0.5) -> DataFrame:
    """Rows, with the ends of the range repeated beyond the opposite ends."""
    lo, hi = bounds(df, [col])[col]
    if lo is None:
        return df
    x, span = F.col(col), hi - lo
    ends = F.array(
        x, F.when(x < span * factor, x + span), F.when(x > hi - span * factor, x - span)
    )
    spread = df.select(*df.columns, F.posexplode(ends).alias("_slot", "_end"))
    # The first slot is the row itself, kept even where its value is unknown.
    spread = spread.filter((F.col("_slot") == 0) | F.col("_end").isNotNull())
    return spread.select(*[F.col("_end").alias(c) if c == col else F.col(c) for c in df.columns])


def cluster_mirror(df: DataFrame, col: str, v: float) -> DataFrame:
    """Double mirror of clustered points; ``cluster_id`` rides along."""
    return double_mirror(df, col, v, strict=True)


def labelled_mix(df: DataFrame, cols: list[str], seed: int | None = None) -> DataFrame:
    """Learning set: label and features. With a seed, rows come in random order."""
    out = df.select("label", *cols)
    return out if seed is None else out.orderBy(F.rand(seed))
