"""The mining flow from a catalog to the reports."""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import cascade, distributions, filters, generate, quality
from ..operators.kernel import ColumnModel
from ..operators.moid import append_moid
from ..scratch import written
from ..sources import catalog
from . import domains

ORBIT_COLUMNS = ["a", "e", "i", "w", "om", "q"]


def near_earth(rows: DataFrame) -> DataFrame:
    """Near-Earth objects of a catalog with a known orbit, without outliers."""
    return filters.cutoff_outliers(filters.get_neas(rows, ORBIT_COLUMNS))


def virtual_population(
    real: DataFrame, num: int, families: dict[str, str] = distributions.DEFAULT_FAMILIES, bins: int = 25,
    seed: int = 7,
) -> DataFrame:
    """``num`` virtual orbits drawn after the real ones, with their distance and label."""
    fitted = distributions.fit_distributions(real, families, bins)
    # written: filters on the distance would repeat the draws' expressions
    drawn = written(generate.gen_orbits(real.sparkSession, fitted, num, seed), "drawn")
    return filters.haz_by_moid(append_moid(drawn))


def mine_neas(rows: DataFrame, num: int, rules: list[Column], path: str) -> DataFrame:
    """Near-Earth objects and ``num`` virtual orbits, labelled by distance and cut into domains.

    Saved under ``path`` by domain and origin (0 stands for no domain) and read back. Virtual orbits
    get negative keys.
    """
    real = near_earth(rows)
    cols = ["oid", *ORBIT_COLUMNS, "moid", "label"]
    known = filters.haz_by_moid(append_moid(real)).select(*cols, F.lit("real").alias("origin"))
    drawn = virtual_population(real, num).withColumn("oid", -1 - F.col("oid"))
    both = known.unionByName(drawn.select(*cols, F.lit("gen").alias("origin")))
    cut = filters.domain_split(both, rules).withColumn("domain", F.coalesce("domain", F.lit(0)))
    catalog.save_dataset(cut, path)
    return catalog.load_dataset(rows.sparkSession, path)


def mine_domain(
    rows: DataFrame, domain: int, features: int = 1024
) -> tuple[DataFrame, DataFrame, dict[str, ColumnModel]]:
    """Extract the hazardous regions of one domain from labelled virtual and real rows.

    Returns the rows with ``extracted`` and ``stage``, the summary and the models. All of domain 4 is
    its region. Group figures of the summary are shares of the rows that the stages see; figures of
    the domain and of an origin are shares of all rows of the domain.
    """
    df = rows.withColumn("domain", F.lit(domain))
    out, models = cascade.run_cascade(domains.prepared(df, domain), domains.flows(domain, features))
    out = out.unionByName(domains.set_aside(df, domain))
    if domain == 4:
        out = out.withColumns({"extracted": F.lit(True), "stage": F.lit("4-all")})
    return out, quality.summary(out), models
