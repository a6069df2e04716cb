"""Tables written between the steps of long jobs.

A written table cuts the lineage, survives the loss of executors, and gives the optimizer real
sizes, so joins against small ones become broadcasts only when they truly are small.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir")
        or sc.getCheckpointDir()
    )
    if shared:
        return f"{shared.rstrip('/')}/orbitsieve-{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="orbitsieve-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[sc.applicationId] = root
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, and let Spark delete the shuffles of ended jobs.

    Otherwise both stay on disk until the session ends, and a long job holds the sum of its steps.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def written_with(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates over the rows, taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, *[v.alias(k) for k, v in sums.items()]), name)
    return out, seen.get
