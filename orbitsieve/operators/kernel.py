"""Splits by trained classifiers.

``MarginSVC`` is a Spark ML estimator for the two support vector machines the mining flow uses.

* ``kernel="linear"``: squared hinge, intercept regularised like the weights.
* ``kernel="rbf"``: hinge (rounded off in a narrow band around the margin), on random Fourier
  features of the kernel exp(-gamma |x - y|^2).

Both are trained in the primal by Newton steps. One step is one distributed pass: every task sums
loss, gradient and Hessian of its rows, the sums are added up block by block on the executors, and the driver
solves a system whose size is the number of features. Features exist only inside a task's block of rows.

For the kernel machine, rows are first counted per micro-cell of a mesh finer than the kernel is
wide; a cell stands at the mean of its rows with their total weight. The trainer then sees a number
of rows bounded by the kernel width, whatever the size of the catalog, every row still counts, and
no key is hot because counting starts before the shuffle.
"""

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame, functions as F

from ..scratch import scratch_path
from . import filters, quality
from .scaling import Scales, bounds, minmax_normalize, unit

BLOCK = 4096  # rows whose features exist at a time
HESS_ROWS = 256  # rows of the Hessian that are sent and added as one block
BANDS = (1.0, 0.5, 0.2)  # half-widths of the rounded hinge, wide to narrow
LENGTHS = 0.6 ** np.arange(1, 21)  # shorter steps tried when a full one goes too far
BIAS = 10.0  # constant feature; makes the penalty on the intercept negligible


class _MarginParams(HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    kernel = Param(Params._dummy(), "kernel", "'linear' or 'rbf'", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |x-y|^2)", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "penalty of one misplaced row", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "random features", TypeConverters.toInt)
    mesh = Param(
        Params._dummy(), "mesh", "micro-cells per kernel width; 0 trains on single rows", TypeConverters.toInt
    )


class MarginSVC(Estimator, _MarginParams):
    """Support vector machine on columns scaled to about [0, 1], labels 1 and 0.

    ``classWeight`` maps labels to factors of C.
    """

    @keyword_only
    def __init__(
        self, *, kernel="rbf", gamma=1.0, C=1.0, classWeight=None, inputCols=None, labelCol="label",
        predictionCol="prediction", numFeatures=1024, mesh=4, seed=17,
    ):
        super().__init__()
        given = dict(self._input_kwargs)
        self.classWeight = given.pop("classWeight", None) or {}
        self._setDefault(
            kernel="rbf", gamma=1.0, C=1.0, labelCol="label", predictionCol="prediction",
            numFeatures=1024, mesh=4, seed=17,
        )
        self._set(**given)

    def _training_rows(self, df: DataFrame) -> DataFrame:
        """Rows (_y, _w, columns): _y is +1/-1, _w the number of rows times the class weight times C."""
        cols, label = self.getInputCols(), self.getLabelCol()
        rows = df.select(F.col(label).cast("int").alias("_label"), *cols).dropna()
        mesh, gamma = self.getOrDefault("mesh"), self.getOrDefault("gamma")
        if self.getOrDefault("kernel") == "rbf" and mesh > 0:
            per_axis = math.ceil(mesh * math.sqrt(2 * gamma))
            cell = [F.floor(F.col(c) * per_axis).alias(f"_k{j}") for j, c in enumerate(cols)]
            rows = rows.groupBy("_label", *cell).agg(
                *[F.avg(c).alias(c) for c in cols], F.count("*").alias("_n")
            )
        else:
            rows = rows.withColumn("_n", F.lit(1))
        factor = F.lit(self.getOrDefault("C"))
        for k, v in self.classWeight.items():
            factor = factor * F.when(F.col("_label") == k, float(v)).otherwise(1.0)
        return rows.select(
            F.when(F.col("_label") == 1, 1.0).otherwise(-1.0).alias("_y"),
            (F.col("_n") * factor).alias("_w"),
            *cols,
        )

    def _fit(self, df: DataFrame) -> "MarginSVCModel":
        cols, rbf = self.getInputCols(), self.getOrDefault("kernel") == "rbf"
        features = (
            _fourier(len(cols), self.getOrDefault("numFeatures"), self.getOrDefault("gamma"), self.getSeed())
            if rbf
            else _affine()
        )
        size = len(features(np.zeros((1, len(cols))))[0])
        rows = train = self._training_rows(df).persist()
        tasks = None
        if rbf:
            # Enough cells per task that its work outweighs the sums it sends.
            width = df.sparkSession.sparkContext.defaultParallelism
            tasks = max(1, min(width, rows.count() // (4 * size)))
            train = rows.repartition(tasks).persist()
        beta = np.zeros(size)
        for band in BANDS if rbf else (None,):
            tol = 1e-2 if rbf and band > BANDS[-1] else 1e-3 if rbf else 1e-9
            beta, status = _newton(train, cols, features, band, beta, tasks, tol)
        train.unpersist()
        rows.unpersist()
        return self._copyValues(MarginSVCModel(features, beta, status))


class MarginSVCModel(Model, _MarginParams):
    """``status`` tells how the last of the fits ended (see ``_newton``)."""

    def __init__(self, features, beta, status="settled"):
        super().__init__()
        self.features, self.beta, self.status = features, beta, status

    def margin(self, *cols):
        """Signed decision value as a Column."""
        features, beta = self.features, self.beta

        @F.pandas_udf("double")
        def decide(*xs: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(s, dtype=float) for s in xs], axis=1)
            out = np.empty(len(x))
            for k in range(0, len(x), BLOCK):
                out[k : k + BLOCK] = features(x[k : k + BLOCK], "float32") @ beta
            return pd.Series(out)

        return decide(*[F.col(c) for c in cols])

    def _transform(self, df: DataFrame) -> DataFrame:
        known = ~F.isnan("_margin")
        hit = F.when(known & (F.col("_margin") > 0), 1).when(known, 0)
        with_margin = df.withColumn("_margin", self.margin(*self.getInputCols()))
        return with_margin.withColumn(self.getPredictionCol(), hit).drop("_margin")


def _affine():
    return lambda x, dtype="float64": np.hstack([x, np.ones((len(x), 1))]).astype(dtype)


def _fourier(dims: int, size: int, gamma: float, seed: int):
    """Features whose inner product approximates the kernel (Rahimi & Recht, 2007)."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, math.sqrt(2 * gamma), (dims, size))
    phase = rng.uniform(0.0, 2 * math.pi, size)
    scale = math.sqrt(2.0 / size)

    def features(x, dtype="float64"):
        wave = np.cos(np.asarray(x, dtype=dtype) @ omega.astype(dtype) + phase.astype(dtype))
        wave *= np.asarray(scale, dtype=dtype)
        return np.hstack([wave, np.full((len(x), 1), BIAS, dtype=dtype)])

    return features


def _loss(short, w, band):
    """Loss, slope and curvature of rows that are ``short`` of their margin."""
    over = np.maximum(short, 0.0)
    if band is None:
        return w * over**2, 2.0 * w * over, np.where(short > 0, 2.0, 0.0) * w
    near = np.abs(short) <= band
    rounded = np.where(near, (short + band) ** 2 / (4 * band), over)
    slope = np.clip((short + band) / (2 * band), 0.0, 1.0)
    return w * rounded, w * slope, np.where(near, w / (2 * band), 0.0)


def _blocks(frames, cols, features):
    for pdf in frames:
        for k in range(0, len(pdf), BLOCK):
            rows = pdf.iloc[k : k + BLOCK]
            yield rows["_y"].to_numpy(), rows["_w"].to_numpy(), features(rows[cols].to_numpy())


def _sums(cols, features, beta, band):
    """Task part of one pass: loss and gradient (block 0) and blocks of rows of the Hessian of the data term."""

    def part(frames):
        size = len(beta)
        loss, grad, hess = 0.0, np.zeros(size), np.zeros((size, size))
        for y, w, z in _blocks(frames, cols, features):
            value, slope, curve = _loss(1.0 - y * (z @ beta), w, band)
            loss += float(value.sum())
            grad -= z.T @ (slope * y)
            active = curve > 0
            za = z[active] * np.sqrt(curve[active])[:, None]
            hess += za.T @ za
        data = [np.append(loss, grad)] + [hess[a : a + HESS_ROWS, a:] for a in range(0, size, HESS_ROWS)]
        yield pd.DataFrame({"block": np.arange(len(data)), "data": [x.tobytes() for x in data]})

    return part


def _tries(cols, features, beta, step, band):
    """Task part of a line search: the loss after each of LENGTHS of the step."""

    def part(frames):
        total = np.zeros(len(LENGTHS))
        for y, w, z in _blocks(frames, cols, features):
            at, along = y * (z @ beta), y * (z @ step)
            total += [_loss(1.0 - at - t * along, w, band)[0].sum() for t in LENGTHS]
        yield pd.DataFrame({"k": np.arange(len(LENGTHS)), "loss": total})

    return part


def _add_blocks(frames):
    """Sums of blocks of the same number, one block of each at a time."""
    total = {}
    for pdf in frames:
        for block, data in zip(pdf["block"], pdf["data"]):
            data = np.frombuffer(data)
            total[block] = total[block] + data if block in total else data
    for block, data in total.items():
        yield pd.DataFrame({"block": [block], "data": [data.tobytes()]})


def _newton(train, cols, features, band, beta, tasks, tol, rounds=30):
    """Minimise |beta|^2 / 2 + data term for one band width, until a step gains less than ``tol``.

    Returns the point and how it ended: ``settled``, ``stuck`` (no shorter step gains) or at the ``limit`` of rounds.
    """
    size = len(beta)
    starts = range(0, size, HESS_ROWS)

    def evaluate(b):
        parts = train.mapInPandas(_sums(cols, features, b, band), "block int, data binary")
        # every block is added up by one task, so that the driver gets one matrix however many tasks there are
        parts = parts.repartition(min(len(starts) + 1, tasks or len(starts) + 1), "block").mapInPandas(_add_blocks, "block int, data binary")
        data = {r["block"]: np.frombuffer(r["data"]) for r in parts.collect()}
        sums, hess = data[0], np.zeros((size, size))
        for k, a in enumerate(starts, 1):
            hess[a : a + HESS_ROWS, a:] = data[k].reshape(-1, size - a)
        hess = np.triu(hess) + np.triu(hess, 1).T + np.eye(size)
        return 0.5 * b @ b + sums[0], b + sums[1:], hess

    value, grad, hess = evaluate(beta)
    for _ in range(rounds):
        step = -np.linalg.solve(hess, grad)
        if -float(grad @ step) <= 1e-3 * tol * abs(value):
            return beta, "settled"
        new = evaluate(beta + step)
        if new[0] >= value:
            tries = train.mapInPandas(_tries(cols, features, beta, step, band), "k int, loss double")
            sums = {r["k"]: r["loss"] for r in tries.groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
            after = [sums[k] + 0.5 * float(np.sum((beta + t * step) ** 2)) for k, t in enumerate(LENGTHS)]
            if min(after) >= value:
                return beta, "stuck"
            step = LENGTHS[int(np.argmin(after))] * step
            new = evaluate(beta + step)
        gained, beta = value - new[0], beta + step
        value, grad, hess = new
        if gained <= tol * abs(value):
            return beta, "settled"
    return beta, "limit"


def on_columns(est: Estimator, cols: list[str], label: str = "label") -> Estimator:
    """Any estimator set to read ``cols``: directly, or through a vector for those that need one."""
    if est.hasParam("inputCols"):
        return est.copy({est.getParam("inputCols"): cols, est.getParam("labelCol"): label})
    vector = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[vector, est.copy({est.getParam("labelCol"): label})])


def _without_summary(model: Model, spark) -> Model:
    """The model as written and read back if it has a training summary, which reading leaves out.

    The summary of two classes holds the session, and a session that has observed metrics can't be sent to tasks.
    """
    if isinstance(model, PipelineModel):
        return PipelineModel([_without_summary(stage, spark) for stage in model.stages])
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(spark, "model")
    model.save(path)
    return type(model).load(path)


class ColumnModel:
    """A fitted model with the columns and bounds it was trained on.

    ``classes`` names the predicted values if the model counts them from 0. A row with an unknown
    (NULL or NaN) column gets no prediction, whatever the model.
    """

    def __init__(self, model: Model, cols: list[str], scales: Scales, classes: list[int] | None = None):
        self.model, self.cols, self.scales = model, cols, {c: scales[c] for c in cols}
        self.classes = classes

    def predict_unit(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` to a frame whose columns are already normalised."""
        extra = {"features", "rawPrediction", "probability"} - set(df.columns)
        out = self.model.transform(df).drop(*extra)
        found = F.col("prediction").cast("int")
        if self.classes is not None:
            found = F.get(F.array(*(F.lit(c) for c in self.classes)), found)
        unknown = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) for c in self.cols))
        return out.withColumn("prediction", F.when(~unknown, found))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` to a frame in physical units."""
        shadow = {f"_x_{c}": F.col(c) for c in self.cols}
        scaled = df.withColumns(shadow).withColumns({c: unit(c, *self.scales[c]) for c in self.cols})
        out = self.predict_unit(scaled)
        return out.withColumns({c: F.col(f"_x_{c}") for c in self.cols}).drop(*shadow)


def fit_columns(
    est: Estimator, df: DataFrame, cols: list[str], scales: Scales, label: str = "label"
) -> ColumnModel:
    """Normalise by ``scales`` and fit."""
    train = minmax_normalize(df.select(label, *cols), cols, scales)[0].dropna()
    return ColumnModel(_without_summary(on_columns(est, cols, label).fit(train), df.sparkSession), cols, scales)


def domain_mask(est: Estimator, df: DataFrame, cols: list[str], scales: Scales) -> ColumnModel:
    """Classifier of in-domain (``in_domain`` = 1) against other rows inside a box of ``scales``."""
    box = {c: scales[c] for c in cols}
    inside = filters.box_filter(df.select("in_domain", *cols), box)
    return fit_columns(est, inside, cols, box, label="in_domain")


def split_by_clf(
    est: Estimator, cols: list[str], train: DataFrame, test: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, ColumnModel]:
    """Fit on ``train``, predict ``test`` (default: the same rows) with common bounds.

    Returns the test rows with ``prediction``, the quality report and the model.
    """
    test = train if test is None else test
    both = train.select(*cols) if test is train else train.select(*cols).unionByName(test.select(*cols))
    model = fit_columns(est, train, cols, bounds(both, cols))
    predicted = model.transform(test)
    return predicted, quality.split_quality(predicted), model
