"""Catalog scan, named datasets, preview."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..schema import CATALOG_SCHEMA, nan_to_null


def scan_catalog(
    spark: SparkSession, path: str, columns: list[str], fmt: str = "csv", schema=CATALOG_SCHEMA,
    key: list[str] | None = None, malformed: Observation | None = None,
) -> DataFrame:
    """The chosen columns of a catalog.

    CSV columns are matched by name: the header may hold any number of others in any order. Only
    the chosen ones are parsed; Parquet reads only theirs. ``key`` names the columns that tell objects apart in
    the file: the result starts with ``oid``, a 64-bit hash of their text, which is the same on every reading (see
    ``key_clashes``). ``malformed`` counts, per column, values that aren't empty and don't have the declared type;
    they become NULL. It is filled in by the first action on the result, in the same pass.
    """
    types = {f.name.lower(): f.dataType for f in schema}
    if fmt == "csv":
        # No inference pass: the header row gives names, values are cast to the declared types.
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    picked = [
        F.col(c).try_cast(types[c.lower()]).alias(c) if c.lower() in types else F.col(c)
        for c in columns
    ]
    oid = []
    if key:
        if "oid" in [c.lower() for c in columns]:
            raise ValueError("a catalog with a column oid needs no key")
        oid = [_key(key).alias("oid")]
    if malformed is not None:
        lost = lambda c, v: (F.trim(F.col(c).cast("string")) != "") & v.isNull()
        raw = raw.observe(malformed, *[F.count_if(lost(c, v)).alias(c) for c, v in zip(columns, picked) if c.lower() in types])
    return nan_to_null(raw.select(*oid, *picked))


def _key(columns: list[str]) -> Column:
    """Hash of the texts of some columns; a missing text differs from an empty one."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.trim(F.col(c).cast("string")))])


def key_clashes(spark: SparkSession, path: str, key: list[str], fmt: str = "csv") -> DataFrame:
    """Keys that more than one row of the file has: (oid, n_rows, n_objects).

    Empty if every row is an object of its own. ``n_objects`` above 1 is a clash of hashes, else rows repeat.
    Rows are counted before they are shuffled.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    names = [F.trim(F.col(c).cast("string")).alias(f"_{j}") for j, c in enumerate(key)]
    per_object = raw.select(_key(key).alias("oid"), *names).groupBy("oid", *[f"_{j}" for j in range(len(key))]).agg(F.count("*").alias("n"))
    return per_object.groupBy("oid").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_objects")).filter(F.col("n_rows") > 1)


def save_dataset(df: DataFrame, path: str, max_records: int = 20_000_000) -> None:
    """Write one folder per (domain, origin); each task writes its own files, nothing shuffles."""
    (
        df.write.mode("overwrite")
        .option("maxRecordsPerFile", max_records)
        .partitionBy("domain", "origin")
        .parquet(path)
    )


def load_dataset(
    spark: SparkSession, path: str, domain: int | None = None, origin: str | None = None
) -> DataFrame:
    """Read a saved dataset; the folders of other domains and origins are not listed or read."""
    df = spark.read.parquet(path)
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    if origin is not None:
        df = df.filter(F.col("origin") == origin)
    return df


def preview(df: DataFrame, k: int = 10) -> DataFrame:
    """First k rows in key order."""
    return df.orderBy("oid").limit(k)
