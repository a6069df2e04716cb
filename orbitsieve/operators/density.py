"""Kernel density estimates, as logarithms that stay finite wherever there is data at all.

A Gaussian splits into one factor per axis, so a task sums its points into the mesh by products of
two thin matrices, and sends one row per mesh point however many rows it read. No point is paired
with the mesh by a join.

Sums are kept as largest exponent and sum scaled by it, which can be merged in any order. Points are taken
cell by cell, in cells so small that the exponents of a cell's points differ by less than REACH at every
mesh point: within a cell the product of the two matrices can't vanish.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import written
from .scaling import Scales, rescaled

BLOCK = 1 << 15
REACH = 300.0  # exponents of one axis within a cell; a double holds down to exp(-708)


def _merged(top, total, other):
    """Largest exponent and scaled sum after adding exp(other)."""
    new = np.maximum(top, other)
    with np.errstate(invalid="ignore"):
        return new, total * np.exp(top - new) + np.exp(other - new)


def _mesh_sums(cols, axes, width):
    def cells(points):
        """The points, cell by cell."""
        spread = [max(p.max(), a[-1]) - min(p.min(), a[0]) for p, a in zip(points.T, axes)]
        keys = [np.floor(p * max(s, width) / (REACH * width * width)) for p, s in zip(points.T, spread)]
        order = np.lexsort(keys)
        keys = np.stack(keys)[:, order]
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        return np.split(points[order], edges)

    def part(frames):
        shape = tuple(len(a) for a in axes)
        top, total, rows = np.full(shape, -np.inf), np.zeros(shape), 0
        for pdf in frames:
            points = pdf[cols].to_numpy(dtype=float)
            points = points[np.isfinite(points).all(axis=1)]
            rows += len(points)
            for k in range(0, len(points), BLOCK):
                for cell in cells(points[k : k + BLOCK]):
                    away = [-((x[:, None] - a) ** 2) / (2 * width * width) for x, a in zip(cell.T, axes)]
                    most = [e.max(axis=0) for e in away]
                    waves = [np.exp(e - m) for e, m in zip(away, most)]
                    if len(cols) == 2:
                        other = np.log(waves[0].T @ waves[1]) + most[0][:, None] + most[1]
                    else:
                        other = np.log(waves[0].sum(axis=0)) + most[0]
                    top, total = _merged(top, total, other)
        if rows:
            index = np.indices(shape).reshape(len(shape), -1)
            frame = {f"k{j}": index[j] for j in range(len(shape))}
            yield pd.DataFrame({**frame, "top": top.ravel(), "total": total.ravel(), "n": rows})

    return part


def _log_density(df: DataFrame, cols: list[str], axes: list[np.ndarray], width: float) -> DataFrame:
    """Rows (k0[, k1], log_density)."""
    keys = [f"k{j}" for j in range(len(cols))]
    schema = ", ".join(f"{k} int" for k in keys) + ", top double, total double, n long"
    sums = df.select(*cols).dropna().mapInPandas(_mesh_sums(cols, axes, width), schema)
    at = Window.partitionBy(*keys)
    scaled = sums.withColumn("peak", F.max("top").over(at))
    total = F.sum(F.col("total") * F.exp(F.col("top") - F.col("peak")))
    unit = len(cols) * math.log(math.sqrt(2 * math.pi) * width)
    return scaled.groupBy(*keys).agg((F.max("peak") + F.log(total) - F.log(F.sum("n")) - unit).alias("log_density"))


def kde_grid(
    df: DataFrame, cols: list[str], bandwidth: float, num: int = 101, levels: int = 4,
    scales: Scales | None = None,
) -> tuple[DataFrame, list[float]]:
    """Log density of normalised points on a num x num mesh of [0, 1]^2, and contour levels.

    Rows (ix, iy, x, y, log_density), x and y in the units of ``scales``; no rows without points.
    """
    axis = np.linspace(0.0, 1.0, num)
    out = _log_density(df, cols, [axis, axis], bandwidth).select(
        F.col("k0").alias("ix"),
        F.col("k1").alias("iy"),
        *[
            rescaled(F.col(k) / (num - 1), *((scales or {}).get(c, (0.0, 1.0)))).alias(n)
            for k, n, c in zip(("k0", "k1"), "xy", cols)
        ],
        "log_density",
    )
    out = written(out, "kde")
    top = out.agg(F.max("log_density")).first()[0]
    return out, list(np.linspace(0.0, top, levels)) if top is not None else []


def scott_bandwidth(df: DataFrame, col: str) -> float:
    row = df.agg(F.stddev_samp(col).alias("s"), F.count(col).alias("n")).first()
    return row["s"] * row["n"] ** -0.2


def kde_pdf(
    df: DataFrame, col: str, points: int = 101, bandwidth: float | None = None,
    span: tuple[float, float] | None = None,
) -> DataFrame:
    """Rows (k, x, density): density of one column on a mesh of its range (or of ``span``)."""
    width = bandwidth or scott_bandwidth(df, col)
    if span is None:
        row = df.agg(F.min(col), F.max(col)).first()
        span = (row[0], row[1])
    lo, hi = span
    out = _log_density(df, [col], [np.linspace(lo, hi, points)], width)
    return out.select(
        F.col("k0").alias("k"), rescaled(F.col("k0") / (points - 1), lo, hi).alias("x"), F.exp("log_density").alias("density")
    )
