"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitsieve.llm import decontaminate, jaccard_join, line_chunks, packing, quality
from orbitsieve.llm.queries import table, tokenizer_path
from orbitsieve.scratch import written

#: Boundaries, trained packing and estimates aren't expressible in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from the texts; ``n_chars`` follows."""
    out = line_chunks.remove_chunks(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the smallest id stays, and of rows
    with the same id and text, one. A row without an id goes if its words are those of a row with one."""
    linked = written(jaccard_join.link_rows(docs, 5, 80), "linked")
    gone = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull())
    rows = linked.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.max(gone).alias("_gone"), F.count("*").alias("_n"))
    rows = written(rows.where("_gone or _n > 1"), "repeats")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_mark"))
    once = docs.join(rows, here, "left_anti")
    return once.union(docs.join(rows.where("not _gone"), here, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in full sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
