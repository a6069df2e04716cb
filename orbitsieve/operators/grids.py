"""Predictions on meshes: the numbers behind decision plots.

``predict`` adds ``prediction`` to a frame of normalised columns, for instance
``ColumnModel.predict_unit``. Mesh sizes are set by the caller and do not grow with the data.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scaling import Scales, rescaled

Predict = Callable[[DataFrame], DataFrame]
UNIT = (0.0, 1.0)


def _spread(k: Column, num: int, lo: float, hi: float) -> Column:
    return F.lit(lo) + k * ((hi - lo) / (num - 1))


def _mesh(spark: SparkSession, num: int) -> DataFrame:
    wide = spark.range(num * num)
    return wide.select(
        (F.col("id") % num).cast("int").alias("ix"), F.floor(F.col("id") / num).cast("int").alias("iy")
    )


def decision_grid(
    spark: SparkSession, predict: Predict, cols: list[str], num: int = 100,
    scales: Scales | None = None, extend: tuple[float, float] | None = None,
) -> DataFrame:
    """Rows (ix, iy, x, y, prediction) on a num x num mesh, x and y in the units of ``scales``.

    ``extend`` predicts only the inner part of an axis that was extended by this share of its range.
    """
    scales = scales or {c: UNIT for c in cols}
    mesh = _mesh(spark, num)
    for k, c, f in zip(("ix", "iy"), cols, extend or (0.0, 0.0)):
        cut = f / (1.0 + 2.0 * f)
        mesh = mesh.withColumn(c, _spread(F.col(k), num, cut, 1.0 - cut))
    out = predict(mesh)
    x, y = (
        rescaled(F.col(k) / (num - 1), *scales[c]).alias(n)
        for k, n, c in zip(("ix", "iy"), "xy", cols)
    )
    return out.select("ix", "iy", x, y, "prediction")


def _mesh3(spark, cols, num, limits) -> DataFrame:
    limits = limits or [UNIT] * 3
    cube = _mesh(spark, num).withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(num - 1))))
    return cube.withColumns(
        {c: _spread(F.col(k), num, *lim) for k, c, lim in zip(("ix", "iy", "iz"), cols, limits)}
    )


def decision_surface(
    spark: SparkSession, predict: Predict, cols: list[str], num: int = 100,
    scales: Scales | None = None, limits=None, masks: list[tuple[Predict, int]] = (),
    mask_level: str = "above",
) -> DataFrame:
    """Rows (ix, iy, x, y, z): the highest layer predicted 1 over each point, 0 if there is none.

    Points for which a mask predicts its value are lifted one above the top of the surface, or
    dropped one below its bottom.
    """
    if mask_level not in ("above", "below"):
        raise ValueError("mask_level is 'above' or 'below'")
    scales = scales or {c: UNIT for c in cols}
    limits = limits or [UNIT] * 3
    x, y, z = cols
    layers = predict(_mesh3(spark, cols, num, limits))
    top = F.max(F.when(F.col("prediction") == 1, F.col(z)))
    flat = layers.groupBy("ix", "iy").agg(F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(0.0)).alias("_z"))
    # Mesh coordinates again from their indices, so that they are not grouping keys.
    flat = flat.withColumns({c: _spread(F.col(k), num, *lim) for k, c, lim in zip(("ix", "iy"), cols, limits)})
    flat = flat.withColumn("_off", F.lit(False))
    for mask, value in masks:
        flat = mask(flat).withColumn("_off", F.col("_off") | (F.col("prediction") == value)).drop("prediction")
    flat = flat.withColumn("_z", F.when(F.col("_off"), 0.0).otherwise(F.col("_z")))
    out = flat.select(
        "ix", "iy", "_off", rescaled(x, *scales[x]).alias("x"), rescaled(y, *scales[y]).alias("y"),
        rescaled("_z", *scales[z]).alias("_zs"),
    )
    if not masks:
        return out.select("ix", "iy", "x", "y", F.col("_zs").alias("z"))
    # The window spans the mesh, num * num rows.
    whole = Window.partitionBy(F.lit(0))
    off = F.max("_zs").over(whole) + 1 if mask_level == "above" else F.min("_zs").over(whole) - 1
    return out.withColumn("_lvl", off).select(
        "ix", "iy", "x", "y", F.when(F.col("_off"), F.col("_lvl")).otherwise(F.col("_zs")).alias("z")
    )


def positive_points(
    spark: SparkSession, predict: Predict, cols: list[str], num: int = 100, limits=None
) -> DataFrame:
    """Mesh points of the cube predicted 1, in normalised units."""
    hits = predict(_mesh3(spark, cols, num, limits)).filter(F.col("prediction") == 1)
    return hits.select("ix", "iy", "iz", *[F.col(c).alias(n) for c, n in zip(cols, "xyz")])


def cluster_points(df: DataFrame, scales: Scales) -> DataFrame:
    """Rows (cluster_id, columns): normalised cluster points back in physical units."""
    return df.select("cluster_id", *[rescaled(c, lo, hi).alias(c) for c, (lo, hi) in scales.items()])
