"""Nearest-mean classification: the plainest split, exact and trained by one aggregate.

A baseline for the kernel machines, and the classifier by which flows of trained stages can be checked to the row.
"""

from functools import reduce
from operator import add

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


class CentroidClassifier(Estimator, HasInputCols, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the mean of each class; rows with an unknown column teach nothing."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CentroidModel":
        cols = self.getInputCols()
        label = F.col(self.getLabelCol()).cast("int").alias("_label")
        means = df.select(label, *cols).dropna().groupBy("_label").agg(*[F.avg(c).alias(c) for c in cols])
        return self._copyValues(CentroidModel({r["_label"]: [r[c] for c in cols] for r in means.collect()}))


class CentroidModel(Model, HasInputCols, HasLabelCol, HasPredictionCol):
    """Predicts the class with the nearest mean, the lower of equally near ones; NULL for an unknown column."""

    def __init__(self, means: dict[int, list[float]]):
        super().__init__()
        self.means = means

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        away = [
            F.struct(reduce(add, [(F.col(c) - m) * (F.col(c) - m) for c, m in zip(cols, mean)]).alias("d"), F.lit(label).alias("label"))
            for label, mean in sorted(self.means.items())
        ]
        best = F.array_min(F.array(*away))["label"] if away else F.lit(None).cast("int")
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols])
        return df.withColumn(self.getPredictionCol(), F.when(known, best))
