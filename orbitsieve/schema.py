"""Catalog schema, with the meaning of each column as its comment."""

from pyspark.sql import DataFrame, functions as F, types as T

_COLUMNS = [
    ("oid", T.LongType(), "stable row key"),
    ("a", T.DoubleType(), "semi-major axis, AU"),
    ("e", T.DoubleType(), "eccentricity"),
    ("i", T.DoubleType(), "inclination, degrees"),
    ("w", T.DoubleType(), "argument of perihelion, degrees"),
    ("om", T.DoubleType(), "longitude of the ascending node, degrees"),
    ("q", T.DoubleType(), "perihelion distance, AU"),
    ("H", T.DoubleType(), "absolute magnitude"),
    ("neo", T.StringType(), "near-Earth flag, Y/N"),
    ("pha", T.StringType(), "hazardous flag, Y/N"),
    ("moid", T.DoubleType(), "minimum distance to the orbit of the Earth, AU"),
    ("n", T.DoubleType(), "mean motion, degrees per day"),
    ("ma", T.DoubleType(), "mean anomaly, degrees"),
    ("epoch", T.DoubleType(), "epoch, Julian days"),
    ("per", T.DoubleType(), "period, days"),
]

CATALOG_SCHEMA = T.StructType(
    [T.StructField(n, t, True, {"comment": c}) for n, t, c in _COLUMNS]
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that comparisons drop it (Spark orders NaN above every number)."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )
