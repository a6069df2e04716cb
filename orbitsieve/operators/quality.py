"""Reports on groups, splits and clusters. One partial and one final aggregate each."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import groups as G


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def group_weight(df: DataFrame, by: str = "origin") -> DataFrame:
    """Class counts per group, their share of all labelled rows, and purity.

    Rows are first counted per (origin, set of groups), a handful of rows; groups on a border and
    the totals are resolved on those.
    """
    haz = F.col("label") == 1
    sets = df.groupBy(by, G.group_mask().alias("mask")).agg(
        _n(haz).alias("pha"), _n(F.col("label") == 0).alias("nha")
    )
    total = F.sum(F.col("pha") + F.col("nha")).over(Window.partitionBy(by))
    return (
        sets.withColumn("total", total)
        .select(by, "pha", "nha", "total", F.explode(G.masked_groups("mask")).alias("grp"))
        .filter(F.col("grp").isNotNull())
        .groupBy(by, "grp", "total")
        .agg(F.sum("pha").alias("n_pha"), F.sum("nha").alias("n_nha"))
        .select(
            by,
            "grp",
            "n_pha",
            "n_nha",
            (F.col("n_pha") + F.col("n_nha")).alias("n"),
            F.try_divide(F.col("n_pha") + F.col("n_nha"), F.col("total")).alias("weight"),
            F.try_divide(F.col("n_pha"), F.col("n_pha") + F.col("n_nha")).alias("purity"),
        )
    )


def split_quality(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Confusion counts, purity of both regions and recall of a prediction."""
    label, pred = F.col("label"), F.col("prediction")
    counts = {
        "pha_in": _n((label == 1) & (pred == 1)),
        "nha_in": _n((label == 0) & (pred == 1)),
        "pha_out": _n((label == 1) & (pred == 0)),
        "nha_out": _n((label == 0) & (pred == 0)),
    }
    out = df.groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()])
    c = F.col
    return out.withColumns(
        {
            "pha_purity": F.try_divide(c("pha_in"), c("pha_in") + c("nha_in")),
            "nha_purity": F.try_divide(c("nha_out"), c("pha_out") + c("nha_out")),
            "recall": F.try_divide(c("pha_in"), c("pha_in") + c("pha_out")),
        }
    )


def summary(df: DataFrame) -> DataFrame:
    """Extraction report per (origin, domain, group), per (origin, domain) and per origin.

    Input: one row per (orbit, group), ``grp`` NULL for orbits in no group, with ``first_tag``
    marking one row of each orbit and ``extracted`` the rows inside a found region. Above the
    group level an orbit of two groups counts once among all, as often as extracted otherwise.
    """
    label, hit = F.col("label"), F.col("extracted")
    keys = ["origin", "domain", "grp"]
    agg = df.rollup(*keys).agg(
        F.grouping_id().alias("level"),
        _n((label == 1) & hit).alias("extracted_pha"),
        _n((label == 0) & hit).alias("trapped_nha"),
        _n(label == 1).alias("pha_tags"),
        _n(label == 0).alias("nha_tags"),
        _n((label == 1) & F.col("first_tag")).alias("pha_rows"),
        _n((label == 0) & F.col("first_tag")).alias("nha_rows"),
    )
    c = F.col
    agg = agg.filter((c("level") < 7) & ~((c("level") == 0) & c("grp").isNull()))
    at_group = c("level") == 0
    return agg.select(
        *keys,
        c("level").cast("int").alias("level"),
        "extracted_pha",
        "trapped_nha",
        F.try_divide(
            c("extracted_pha"), F.when(at_group, c("pha_tags")).otherwise(c("pha_rows"))
        ).alias("pha_fraction"),
        F.try_divide(
            c("trapped_nha"), F.when(at_group, c("nha_tags")).otherwise(c("nha_rows"))
        ).alias("nha_fraction"),
        F.try_divide(c("extracted_pha"), c("extracted_pha") + c("trapped_nha")).alias("purity"),
    )


def tagged_for_summary(df: DataFrame) -> DataFrame:
    """One row per (orbit, group) with ``first_tag``; orbits in no group keep one row."""
    tags = F.posexplode_outer(G.group_array()).alias("pos", "grp")
    out = df.select("*", tags)
    return out.withColumn("first_tag", F.coalesce("pos", F.lit(0)) == 0).drop("pos")


def cluster_haz_fraction(df: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Share of hazardous rows in each cluster."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("label")).alias("haz_fraction"))


def prediction_score(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, predicted and true share of hazardous rows."""
    share = lambda cond: F.avg(cond.cast("int"))
    return df.groupBy(*by).agg(
        share(F.col("prediction") == F.col("label")).alias("score"),
        share(F.col("prediction") == 1).alias("predicted_haz_fraction"),
        share(F.col("label") == 1).alias("true_haz_fraction"),
    )
