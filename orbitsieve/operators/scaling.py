"""Bounds of columns, normalising by them and back.

Bounds are one aggregated row (two numbers per column), read once and put into later
expressions as literals, so normalising is a plain projection without any join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import nan_to_null

Scales = dict[str, tuple[float, float]]


def _tagged_union(datasets: list[DataFrame], cols: list[str]) -> DataFrame:
    for df in datasets:
        missing = set(cols) - set(df.columns)
        if missing:
            raise ValueError(f"columns of the datasets do not match, missing {sorted(missing)}")
    return reduce(DataFrame.unionByName, [df.select(*cols) for df in datasets])


def param_bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: smallest and largest known value of each column."""
    return nan_to_null(df.select(*dict.fromkeys(cols))).agg(
        *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    )


def common_bounds(datasets: list[DataFrame], cols: list[str]) -> DataFrame:
    """One row: bounds of each column over several datasets."""
    return param_bounds(_tagged_union(datasets, cols), cols)


def df_common_bounds(datasets: list[DataFrame], cols: list[str]) -> DataFrame:
    """Rows (col, lo, hi): bounds of each column over several datasets."""
    stacked = ", ".join(f"'{c}', `{c}_min`, `{c}_max`" for c in cols)
    return common_bounds(datasets, cols).selectExpr(f"stack({len(cols)}, {stacked}) AS (col, lo, hi)")


def common_scales(scale_sets: list[DataFrame]) -> DataFrame:
    """Merge several (col, lo, hi) tables."""
    merged = reduce(DataFrame.unionByName, scale_sets)
    return merged.groupBy("col").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bounds(df: DataFrame, cols: list[str]) -> Scales:
    """Bounds as a dict, for use in expressions."""
    row = param_bounds(df, cols).first()
    return {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in cols}


def unit(col, lo: float, hi: float) -> Column:
    """(x - lo) / (hi - lo); NULL when the column is constant."""
    c = F.col(col) if isinstance(col, str) else col
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    return F.try_divide(c - F.lit(lo), F.lit(hi) - F.lit(lo))


def minmax_normalize(
    df: DataFrame, cols: list[str], scales: Scales | None = None
) -> tuple[DataFrame, Scales]:
    """Columns scaled to [0, 1] by their own or by given bounds, and the bounds used."""
    scales = scales or bounds(df, cols)
    return df.withColumns({c: unit(c, *scales[c]) for c in cols}), scales


def cut_normalize(
    cols: list[str], datasets: dict[str, DataFrame], keep: tuple[str, ...] = ("label",)
) -> tuple[DataFrame, Scales]:
    """Several datasets, projected and normalised by bounds common to all of them.

    Returns one frame with the dataset name in ``dataset``, and the bounds.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("dataset"), *keep, *cols) for name, df in datasets.items()],
    )
    return minmax_normalize(tagged, cols)


def rescaled(col, lo: float, hi: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c * F.lit(float(hi) - float(lo)) + F.lit(float(lo))


def rescale(df: DataFrame, scales: Scales) -> DataFrame:
    """Inverse of ``minmax_normalize``."""
    return df.withColumns({c: rescaled(c, lo, hi) for c, (lo, hi) in scales.items()})
