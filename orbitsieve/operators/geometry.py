"""Orbit geometry columns and point rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import orbital as O


def with_orbit_columns(df: DataFrame) -> DataFrame:
    """Add period, node distance and the centre of the ellipse."""
    c = O.orbit_center()
    return df.withColumns(
        {
            "per": O.period(),
            "rasc": O.node_distance(),
            "cx": c["x"],
            "cy": c["y"],
            "cz": c["z"],
        }
    )


def orbit_polyline(df: DataFrame, n: int = 100) -> DataFrame:
    """Rows (oid, k, theta, x, y, z): n + 1 points around each orbit."""
    points = df.select("oid", "a", "e", "i", "w", "om", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    points = points.withColumn("theta", O.polyline_angle("k", n))
    p = points.withColumn("p", O.orbit_point("theta"))
    return p.select("oid", "k", "theta", "p.x", "p.y", "p.z")


def ellipse_polyline(df: DataFrame, n: int = 50) -> DataFrame:
    """Rows (oid, k, x, y): n points of the flat ellipse with the Sun at the origin."""
    t = F.radians(F.col("k") * (360.0 / (n - 1)))
    a, e = F.col("a"), F.col("e")
    return df.select("oid", "a", "e", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        "oid",
        "k",
        (a * F.cos(t) + a * e).alias("x"),
        (a * F.sqrt(1 - e * e) * F.sin(t)).alias("y"),
    )


def earth_ring(spark, n: int = 100) -> DataFrame:
    """n points around the orbit of the Earth."""
    ring = spark.range(n).select(F.col("id").cast("int").alias("k"))
    p = ring.withColumn("p", O.earth_point(F.col("k") * (K.TWO_PI / (n - 1))))
    return p.select("k", "p.x", "p.y", "p.z")


def unit_circle(spark, n: int = 50) -> DataFrame:
    """n points of the circle that stands for the Earth beside flat ellipses."""
    t = F.radians(F.col("id") * (360.0 / (n - 1)))
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.cos(t).alias("x"), F.sin(t).alias("y"))


def plane_points(a, e, i, w, om, t):
    """x, y, z (numpy) of orbits (rows; angles in degrees) at true anomalies ``t`` (columns)."""
    a, e, i, w, om = (np.asarray(v, dtype=float)[:, None] for v in (a, e, i, w, om))
    r = a * (1 - e * e) / (1 + e * np.cos(t))
    u, node, tilt = t + np.radians(w), np.radians(om), np.radians(i)
    x = r * (np.cos(node) * np.cos(u) - np.sin(node) * np.sin(u) * np.cos(tilt))
    y = r * (np.sin(node) * np.cos(u) + np.cos(node) * np.sin(u) * np.cos(tilt))
    return x, y, r * np.sin(u) * np.sin(tilt)


def least_of_points(angles, measure, schema: str):
    """Column function (a, e, i, w, om): ``measure`` of each orbit's points, where its first value is least.

    Works row by row on Arrow batches: no key, no shuffle; NULL for an orbit with an unknown element."""
    angles = np.asarray(angles, dtype=float)
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def least(a: pd.Series, e: pd.Series, i: pd.Series, w: pd.Series, om: pd.Series) -> pd.DataFrame:
        parts = []
        for k in range(0, len(a), POINT_BLOCK):
            values = measure(angles, *plane_points(*[c.iloc[k : k + POINT_BLOCK] for c in (a, e, i, w, om)], angles))
            values = [np.broadcast_to(v, values[0].shape) for v in values]
            known = np.isfinite(values[0]).all(1)
            at = np.where(known[:, None], values[0], 0).argmin(1)
            parts.append([np.where(known, v[np.arange(len(at)), at], np.nan) for v in values])
        columns = [np.concatenate(v) for v in zip(*parts)] if parts else [[] for _ in names]
        return pd.DataFrame(dict(zip(names, columns))).astype(float)

    cleared = lambda v: F.struct(*[F.nanvl(v[n], F.lit(None).cast("double")).alias(n) for n in names])
    return lambda a="a", e="e", i="i", w="w", om="om": cleared(least(a, e, i, w, om))


POINT_BLOCK = 4096  # orbits whose points exist at a time


def polyline_angles(n: int) -> list[float]:
    """The n + 1 angles of a polyline: dense near the ends of the long axis."""
    half = [math.pi * math.sin(k * math.pi / n) for k in range(n + 1)]
    return [h if k <= n // 2 else K.TWO_PI - h for k, h in enumerate(half)]


def ecliptic_closest(df: DataFrame, n: int = 100) -> DataFrame:
    """Rows (oid, rx, ry): smallest in-plane gap to radius 1 along the orbit, and the height there. One row per row."""
    near = least_of_points(polyline_angles(n), lambda t, x, y, z: (np.abs(np.hypot(x, y) - 1), z), "rx double, ry double")
    return df.select("oid", near().alias("p")).select("oid", "p.rx", "p.ry")
