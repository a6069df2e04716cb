"""Orbits derived from the ``lineitem`` table: the input of all registered queries."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# One text for both engines; {lineitem} is the only thing that differs.
ORBITS_SQL = """
WITH k AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS oid, l_linenumber AS lno FROM {lineitem}),
b AS (SELECT oid, lno,
  0.15e0 + 1.15e0*(((oid*7919 + 17) % 100003) / 100003e0) AS q,
  0.02e0 + 0.83e0*(((oid*104729 + 29) % 99991) / 99991e0) AS e,
  60e0*(((oid*15485863 + 41) % 99989) / 99989e0) AS i,
  360e0*(((oid*32452843 + 53) % 99971) / 99971e0) AS w,
  360e0*(((oid*49979687 + 61) % 99961) / 99961e0) AS om,
  14e0 + 14e0*(((oid*67867967 + 71) % 99929) / 99929e0) AS h FROM k),
c AS (SELECT *, q/(1e0-e) AS a FROM b),
d AS (SELECT *, LEAST(ABS(a*(1e0-e*e)/(1e0+e*COS(RADIANS(w)))-1e0),
                      ABS(a*(1e0-e*e)/(1e0-e*COS(RADIANS(w)))-1e0)) AS moid FROM c)
SELECT oid, CASE WHEN lno <= 5 THEN 'gen' ELSE 'real' END AS origin, a, e, i, w, om, q, h, moid,
  CASE WHEN oid % 17 = 0 THEN 'N' ELSE 'Y' END AS neo,
  CASE WHEN oid % 101 = 0 THEN NULL
       WHEN moid <= 0.05e0 AND h < 22e0 THEN 'Y' ELSE 'N' END AS pha
FROM d
"""


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    rows = spark.sql(ORBITS_SQL, lineitem=lines)
    # One element per row: a condition on a computed column is tested on its value. Without this it moves down to the
    # scan with the whole formula written out for each use, which takes ten times as long as the formulas themselves.
    return rows.select(F.inline(F.array(F.struct("*"))))
