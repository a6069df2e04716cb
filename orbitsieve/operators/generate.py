"""Virtual orbits: row-local expressions over ``spark.range``, no shuffle and no redraw loop."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import orbital as O
from .distributions import (
    Fitted, below, cut_density, draws, quantile, share_below, uniform_distributions, uniform_rows,
)


def gen_orbits(spark: SparkSession, dists: dict[str, Fitted], num: int, seed: int = 7) -> DataFrame:
    """Exactly ``num`` orbits with independent parameters, given that 0 < e = (a - q) / a < 1.

    Redrawing orbits until q < a amounts to drawing ``a`` with its density times the share of
    perihelia below it, then ``q`` from its density cut at ``a``. That is done directly.
    """
    a, q = dists["a"], dists["q"]
    if q.lo >= a.hi:
        raise ValueError("no perihelion distance is below a semi-major axis")
    a = cut_density(a, lambda places: below(q, np.clip(places, q.lo, q.hi)))
    rows = uniform_rows(spark, num, list(dists), seed)
    others = [quantile(d, F.col(f"_r_{c}")).alias(c) for c, d in dists.items() if c not in ("a", "q")]
    rows = rows.select("oid", "_r_q", quantile(a, F.col("_r_a")).alias("a"), *others)
    drawn = quantile(q, F.col("_r_q") * share_below(q, F.col("a")))
    # Interpolation may end a hair above the cut.
    closed = F.greatest(F.least(drawn, F.col("a") * (1 - 1e-9)), F.col("a") * 1e-9)
    rows = rows.withColumn("q", closed).drop("_r_q")
    return rows.withColumn("e", O.eccentricity())


def gen_orbits_raw(
    spark: SparkSession, num: int, dists: dict[str, Fitted] | None = None, seed: int = 7
) -> DataFrame:
    """``num`` orbits without a validity check (e may be negative), with the period.

    Without distributions, every parameter is uniform on its fixed bounds.
    """
    rows = draws(spark, num, dists or uniform_distributions(K.UNIFORM_BOUNDS), seed)
    return rows.withColumns({"e": O.eccentricity(), "per": O.period()})


def gen_orbits_inout(
    spark: SparkSession, common: dict[str, Fitted], inner: Fitted, outer: Fitted, num: int,
    bound: float = 1.0, seed: int = 7,
) -> DataFrame:
    """``num`` orbits whose w follows ``inner`` up to q = bound and ``outer`` beyond; a from q and e."""
    rows = uniform_rows(spark, num, [*common, "w"], seed)
    rows = rows.select("oid", "_r_w", *[quantile(d, F.col(f"_r_{c}")).alias(c) for c, d in common.items()])
    w = F.when(F.col("q") <= bound, quantile(inner, F.col("_r_w"))).otherwise(quantile(outer, F.col("_r_w")))
    rows = rows.withColumn("w", w).drop("_r_w")
    return rows.withColumns({"a": O.semimajor(), "e": F.when(F.col("e") >= 1.0, 0.99).otherwise(F.col("e"))})
