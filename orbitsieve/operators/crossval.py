"""Cross validation."""

from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import nan_to_null
from ..scratch import written
from .kernel import fit_columns
from .quality import prediction_score
from .scaling import Scales, bounds


def fit_predict(
    est: Estimator, cols: list[str], train: DataFrame, test: DataFrame, scales: Scales | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train`` (normalised by its bounds), predict ``test``; rows and their score."""
    predicted = fit_columns(est, train, cols, scales or bounds(train, cols)).transform(test)
    return predicted, prediction_score(predicted)


def training_bounds(tagged: DataFrame, cols: list[str], folds: int) -> list[Scales]:
    """Bounds of the rows outside each fold: one aggregate by fold, merged per fold."""
    marks = [f(c).alias(f"{n}{j}") for j, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    own = {r["fold"]: r for r in nan_to_null(tagged.select("fold", *cols)).groupBy("fold").agg(*marks).collect()}
    known = lambda k, n: [r[n] for f, r in own.items() if f != k and r[n] is not None]
    return [
        {c: (min(known(k, f"lo{j}"), default=None), max(known(k, f"hi{j}"), default=None)) for j, c in enumerate(cols)}
        for k in range(folds)
    ]


def kfold(
    est: Estimator, cols: list[str], df: DataFrame, folds: int = 3, key: str = "oid", fold: Column | None = None
) -> DataFrame:
    """Score per fold. A row's fold is ``fold`` or depends on its key alone, whatever the partitioning.

    The rows are written once with their folds; all folds read that table.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(folds)) if fold is None else fold
    tagged = written(df.select(*dict.fromkeys([*cols, "label"]), fold.cast("int").alias("fold")), "folds")
    scales = training_bounds(tagged, cols, folds)
    parts = [
        fit_predict(est, cols, tagged.filter(F.col("fold") != k), tagged.filter(F.col("fold") == k), scales[k])[0]
        for k in range(folds)
    ]
    rows = reduce(DataFrame.unionByName, [p.select("fold", "label", "prediction") for p in parts])
    return prediction_score(rows, ["fold"])
