"""Shape of the physical plans: scans, exchanges, joins."""

import pytest
from pyspark.sql import functions as F

from orbitsieve.operators import augment, filters, geometry, moid, quality
from orbitsieve.scratch import scratch_root, written
from orbitsieve.sources.fixture import orbits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, orbit_rows):
    return written(orbit_rows, "orbits")


@pytest.mark.parametrize(
    "copies",
    [
        lambda d: augment.mirror(d, "w", 180.0),
        lambda d: augment.double_mirror(d, "w", 180.0),
        lambda d: augment.shift_mirror(d, "w", 180.0),
        lambda d: augment.extend_copies(d, "w", 0.25),
        augment.union_groups,
    ],
)
def test_copies_scan_once_without_shuffle(table, copies):
    text = plan(copies(table))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text


def test_filters_and_columns_reach_the_scan(table):
    text = plan(filters.cut_magnitude(filters.get_neas(table, ["pha"])).select("oid", "h"))
    assert "PushedFilters: [" in text and "LessThan(h,22.0)" in text and "EqualTo(neo,Y)" in text
    assert "ReadSchema: struct<oid:bigint,h:double,neo:string,pha:string>" in text


def test_group_weight_counts_before_the_shuffle(table):
    text = plan(quality.group_weight(filters.haz_by_flag(table)))
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "partial_count" in text or "partial_sum" in text


def test_nearest_points_need_no_key_and_no_shuffle(table):
    for near in (geometry.ecliptic_closest, moid.moid_coarse):
        text = plan(near(table))
        assert "Exchange" not in text and "Generate" not in text and "Aggregate" not in text
        twice = near(table.limit(5).unionByName(table.limit(5))).collect()
        assert len(twice) == 10 and sorted(twice[:5]) == sorted(twice[5:])


def test_no_cross_joins_in_reports(table):
    df = filters.haz_by_flag(table)
    tagged = quality.tagged_for_summary(df.withColumn("domain", F.lit(1))).withColumn("extracted", F.lit(True))
    assert "NestedLoop" not in plan(quality.summary(tagged)) and "Cartesian" not in plan(quality.summary(tagged))


class FakeSession:
    """Session of a cluster with or without a shared folder."""

    def __init__(self, shared):
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}
        self.sparkContext = self
        self.applicationId, self.master = "app-1", "spark://host:7077"

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


def test_scratch_follows_the_checkpoint_setting():
    assert scratch_root(FakeSession("hdfs://shared/")) == "hdfs://shared/orbitsieve-app-1"
    with pytest.raises(RuntimeError):
        scratch_root(FakeSession(None))


def test_conditions_stay_above_the_orbit_formulas(spark, tmp_path):
    """A condition on a computed column is tested on its value and not as a formula on the rows of the scan."""
    lines = spark.createDataFrame([(1, 1), (2, 6)], "l_orderkey long, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = filters.haz_by_moid(orbits(spark, str(tmp_path))).filter("origin = 'gen'").select("oid", "w", "q", "label")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("cos(") == 2  # both nodes of the orbit, once each


def test_fitted_inout_orbits_are_worked_out_once(spark, tmp_path, monkeypatch):
    from orbitsieve.plans import model_queries as M

    lines = spark.createDataFrame([(k, k % 7 + 1) for k in range(300)], "l_orderkey long, l_linenumber int")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    monkeypatch.setattr(M.distributions, "fit_distributions", lambda df, families: seen.append(df) or dict.fromkeys(families))
    monkeypatch.setattr(M.generate, "gen_orbits_inout", lambda spark, common, inner, outer, num: num)
    assert M.gen_orbits_inout_fitted(spark, str(tmp_path)) == sum(k % 7 + 1 > 5 for k in range(300))
    assert len(seen) == 3
    for df in seen:
        assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
