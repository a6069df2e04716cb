"""Staged extraction of regions rich in hazardous orbits.

A cascade is a list of stages per near-Earth group. Every stage trains on virtual rows (possibly
cut and mirrored), predicts virtual and real rows alike, and hands on the rows it left out
(``follow='rest'``) or the rows it took (``follow='inside'``, where only the last such stage counts).
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups as G
from ..scratch import written
from . import quality
from .kernel import ColumnModel, fit_columns
from .scaling import bounds

FEATURES = ("a", "e", "i", "w", "om", "q")


@dataclass
class Stage:
    """One trained split.

    ``where`` (a condition) keeps the rows the stage works on; ``augment`` and then ``train_where``
    shape only the training rows. ``counts=False`` evaluates a stage without adding its rows to the
    result.
    """

    name: str
    cols: list[str]
    estimator: Callable[[], Estimator]
    where: Callable[[], Column] | None = None
    augment: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    train_where: Callable[[], Column] | None = None
    follow: str = "rest"
    counts: bool = True


@dataclass
class Flow:
    """The stages of one group, or of several groups taken together as a bag."""

    groups: tuple[str, ...]
    stages: list[Stage]


def group_rows(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Rows of the groups with their group in ``grp``; a row on a border appears once per group."""
    tags = F.array(*[F.when(G.GROUPS[g](), F.lit(g)) for g in groups])
    return df.withColumn("grp", F.explode(tags)).filter(F.col("grp").isNotNull())


def run_stage(stage: Stage, rows: DataFrame) -> tuple[DataFrame, ColumnModel]:
    """Train on the virtual rows and add ``prediction`` to all rows."""
    features = [c for c in FEATURES if c in rows.columns]
    train = rows.filter(F.col("origin") == "gen").select("label", *features)
    for step in stage.augment:
        train = step(train)
    if stage.train_where:
        train = train.filter(stage.train_where())
    scales = bounds(rows.select(*stage.cols).unionByName(train.select(*stage.cols)), stage.cols)
    model = fit_columns(stage.estimator(), train, stage.cols, scales)
    return model.transform(rows), model


def run_cascade(df: DataFrame, flows: list[Flow]) -> tuple[DataFrame, dict[str, ColumnModel]]:
    """Run all flows over labelled rows with ``origin``.

    Returns one row per (orbit, group) with ``extracted`` (inside a counted region) and ``stage``
    (name of the region, NULL outside), ready for ``quality.summary``; and the models. The result
    is put together from the parts the stages leave behind, so no rows are joined or shuffled.
    """
    models: dict[str, ColumnModel] = {}
    parts: list[DataFrame] = []

    def leave(rows: DataFrame, stage: str | None = None) -> None:
        parts.append(rows.withColumn("stage", F.lit(stage).cast("string")))

    tagged = quality.tagged_for_summary(df)
    mined = [g for flow in flows for g in flow.groups]
    leave(tagged.filter(~F.coalesce(F.col("grp").isin(mined), F.lit(False))) if mined else tagged)
    for flow in flows:
        rows = written(tagged.filter(F.col("grp").isin(*flow.groups)), "flow")
        for stage in flow.stages:
            if stage.where:
                kept = F.coalesce(stage.where(), F.lit(False))
                leave(rows.filter(~kept))
                rows = rows.filter(kept)
            predicted, models[stage.name] = run_stage(stage, rows)
            # The table cuts the lineage: later stages read it and not the models before it.
            predicted = written(predicted, "stage")
            taken = F.coalesce(F.col("prediction") == 1, F.lit(False))
            inside, rest = (predicted.filter(c).drop("prediction") for c in (taken, ~taken))
            if stage.follow == "inside":
                leave(rest)
                rows = inside
            else:
                leave(inside, stage.name if stage.counts else None)
                rows = rest
        leave(rows)
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("extracted", F.col("stage").isNotNull()), models
