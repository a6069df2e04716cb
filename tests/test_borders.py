"""Hand-made rows on the borders of the rules, unknown values, and row-count properties."""

import math

import pytest
from pyspark.sql import functions as F

from orbitsieve.operators import augment, filters, histogram, quality, scaling
from orbitsieve.operators.clusters import fuse_clusters
from orbitsieve.schema import nan_to_null
from orbitsieve.sources import catalog


def groups_of(spark, a, q):
    df = spark.createDataFrame([(1, a, q)], "oid long, a double, q double")
    return {r["grp"] for r in filters.group_tags(df).collect()}


def test_group_borders(spark):
    tie_q = 1.5 - 0.983
    assert 2 * 0.75 - tie_q == 0.983
    assert groups_of(spark, 0.75, tie_q) == {"atira", "aten"}
    assert groups_of(spark, 1.0, 0.9) == {"aten", "apollo"}
    assert groups_of(spark, 1.5, 1.017) == {"apollo"}
    assert groups_of(spark, 1.6, 1.3) == set()


def test_tie_is_kept_twice(spark):
    df = spark.createDataFrame([(1, 0.75, 1.5 - 0.983), (2, 0.5, 0.4)], "oid long, a double, q double")
    assert sorted(r["oid"] for r in augment.union_groups(df).collect()) == [1, 1, 2]


def test_hazard_borders(spark):
    df = spark.createDataFrame(
        [(1, 22.0, 0.05), (2, 21.9, 0.06), (3, None, None), (4, math.nan, math.nan)],
        "oid long, h double, moid double",
    )
    df = nan_to_null(df)
    by_h = {r["oid"]: r["label"] for r in filters.haz_by_h(df).collect()}
    by_moid = {r["oid"]: r["label"] for r in filters.haz_by_moid(df).collect()}
    assert by_h == {1: 0, 2: 1}
    assert by_moid == {1: 1, 2: 0}


def values(df, col="w"):
    return [r[col] for r in df.select(col).collect()]


def test_double_mirror_at_the_border(spark):
    df = spark.createDataFrame([(1, 180.0)], "oid long, w double")
    assert sorted(values(augment.double_mirror(df, "w", 180.0))) == sorted([180.0, 0.0, 180.0, 360.0])
    assert sorted(values(augment.cluster_mirror(df, "w", 180.0))) == sorted([180.0, 360.0, 180.0, 0.0])


def test_copies_multiply_rows_and_keep_unknowns(spark, orbit_rows):
    df = orbit_rows.select("oid", "w")
    n = df.count()
    for fn, times in ((augment.mirror, 2), (augment.shift_mirror, 3), (augment.double_mirror, 4)):
        out = fn(df, "w", 180.0)
        assert out.count() == times * n
        low, high = out.agg(F.min("w"), F.max("w")).first()
        assert 0 <= low and high <= 360
    unknown = spark.createDataFrame([(1, None), (2, 10.0), (3, 350.0)], "oid long, w double")
    assert {r["oid"] for r in augment.extend_copies(unknown, "w").collect()} == {1, 2, 3}


def test_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "oid long, a double")
    assert values(scaling.minmax_normalize(df, ["a"])[0], "a") == [None, None]


def test_rescale_inverts_normalize(orbit_rows):
    scaled, scales = scaling.minmax_normalize(orbit_rows.select("oid", "a", F.col("a").alias("was")), ["a"])
    back = scaling.rescale(scaled, scales)
    assert back.filter(F.abs(F.col("a") - F.col("was")) > 1e-9).isEmpty()


def test_missing_column_is_an_error(orbit_rows):
    with pytest.raises(ValueError):
        scaling.common_bounds([orbit_rows, orbit_rows.drop("a")], ["a"])


def test_line_is_the_same_from_both_ends(orbit_rows):
    p1, p2 = (0.545, 0.15), (0.945, 0.95)
    df = orbit_rows.withColumn("s", filters.side_of_line(p1, p2, "a", "q")).withColumn(
        "t", filters.side_of_line(p2, p1, "a", "q")
    )
    assert df.filter(F.col("s") != F.col("t")).isEmpty()


def test_histogram_integrates_to_one(orbit_rows):
    h = histogram.hist_table(orbit_rows, ["a", "i"], 25)
    for r in h.groupBy("name").agg(F.sum(F.col("density") * F.col("width")).alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_empty_region_has_no_purity(orbit_rows):
    df = filters.haz_by_flag(orbit_rows).withColumn("prediction", F.lit(0))
    row = quality.split_quality(df).first()
    assert row["pha_purity"] is None and row["recall"] == 0.0


def test_fuse_clusters(spark):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, 4)], "oid long, cluster_id int")
    got = {r["oid"]: r["class_id"] for r in fuse_clusters(df, 7).collect()}
    assert got == {1: None, 2: 7, 3: 7}
    assert fuse_clusters(df, 7, tail=True).filter("class_id = 7").count() == 3


def test_catalog_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,pha,q,extra,a,H\nx,Y,0.9,1,1.5,\ny,N,NaN,2,2.5,21.5\n")
    rows = catalog.scan_catalog(spark, str(tmp_path / "c.csv"), ["a", "q", "H", "pha"]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1.5, 0.9, None, "Y"), (2.5, None, 21.5, "N")]


def test_dataset_folders_are_pruned(spark, tmp_path, orbit_rows):
    path = str(tmp_path / "d")
    df = filters.domain_split(orbit_rows, [F.col("q") < 0.5, F.col("q") < 1.0])
    catalog.save_dataset(df.filter("domain is not null"), path)
    one = catalog.load_dataset(spark, path, 2, "real")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    assert one.count() == df.filter("domain = 2 and origin = 'real'").count()


def test_catalog_gets_a_key_and_counts_bad_values(spark, tmp_path):
    from pyspark.sql import Observation

    from orbitsieve.sources import catalog

    path = str(tmp_path / "catalog.csv")
    with open(path, "w") as f:
        f.write("des,name,a,q,neo\n2024 AB,, 1.5,0.9,Y\n2024 AC,x,bad,0.8,N\n2024 AD,x,,oops,N\n2024 AB,,1.5,0.9,Y\n")
    seen = Observation()
    rows = catalog.scan_catalog(spark, path, ["a", "q", "neo"], key=["des", "name"], malformed=seen)
    first = rows.collect()
    assert rows.columns == ["oid", "a", "q", "neo"]
    assert seen.get == {"a": 1, "q": 1, "neo": 0}
    assert first[0].oid == first[3].oid and len({r.oid for r in first}) == 3
    again = catalog.scan_catalog(spark, path, ["a", "q", "neo"], key=["des", "name"]).repartition(3).collect()
    assert sorted(r.oid for r in again) == sorted(r.oid for r in first)
    clash = catalog.key_clashes(spark, path, ["des", "name"]).collect()
    assert [tuple(r) for r in clash] == [(first[0].oid, 2, 1)]
    assert catalog.key_clashes(spark, path, ["des", "a", "q"]).count() == 1
    with pytest.raises(ValueError):
        catalog.scan_catalog(spark, path, ["oid"], key=["des"])


def test_histogram_of_dates_and_its_limit(spark):
    from orbitsieve.operators import histogram

    days = spark.range(1000).select((F.lit(2444221.5) + F.col("id") * 13.0).alias("epoch"))
    h = histogram.hist_density(days, "epoch", 50)
    top = 2444221.5 + 999 * 13.0
    assert h.count() == int(top * 50 / (999 * 13.0)) - 1
    assert abs(h.agg(F.sum(F.col("density") * F.col("width"))).first()[0] - 1) < 1e-9
    with pytest.raises(ValueError):
        histogram.hist_density(spark.createDataFrame([(1e9,), (1e9 + 1,)], "x double"), "x", 50)


def test_nearest_means_are_a_real_estimator(spark, tmp_path):
    from orbitsieve.operators.centroid import CentroidClassifier

    est = CentroidClassifier(inputCols=["x", "y"])
    est.write().overwrite().save(str(tmp_path / "est"))
    est = CentroidClassifier.load(str(tmp_path / "est"))
    rows = [(0.0, 0.0, 0), (0.0, 2.0, 0), (4.0, 0.0, 1), (4.0, 2.0, 1), (None, 1.0, 1)]
    model = est.fit(spark.createDataFrame(rows, "x double, y double, label int"))
    asked = spark.createDataFrame([(2.0, 5.0), (2.1, 0.0), (None, 0.0), (float("nan"), 0.0)], "x double, y double")
    assert [r.prediction for r in model.transform(asked).collect()] == [0, 1, None, None]
