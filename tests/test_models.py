import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import Observation, functions as F

from orbitsieve.operators import cascade, clusters, crossval, filters, grids, kernel, quality, scaling
from orbitsieve.operators.cascade import Flow, Stage
from orbitsieve.plans import domains, flows


def labelled(orbit_rows):
    return filters.haz_by_moid(orbit_rows).persist()


def test_kernel_quality_floor_and_more_features_help(orbit_rows):
    df = labelled(orbit_rows)
    recalls = []
    for size in (128, 1024):
        est = kernel.MarginSVC(gamma=40.0, C=10.0, numFeatures=size)
        report = kernel.split_by_clf(est, ["w", "q", "e"], df)[1].first()
        recalls.append(report["recall"])
    assert report["pha_purity"] > 0.75 and recalls[1] > 0.5 and recalls[1] > recalls[0]


def exact_hinge(x, y, gamma, c, sweeps=200):
    """Dual coordinate ascent with the exact kernel; the added 1 stands for the intercept."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)) + 1.0
    q = k * np.outer(y, y)
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(sweeps):
        for i in range(len(y)):
            new = min(max(alpha[i] - grad[i] / q[i, i], 0), c)
            if new != alpha[i]:
                grad += (new - alpha[i]) * q[:, i]
                alpha[i] = new
    return y * (grad + 1)


def test_kernel_split_agrees_with_the_exact_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (900, 2))
    y = np.where(np.hypot(x[:, 0] - 0.5, x[:, 1] - 0.4) < 0.3, 1.0, -1.0)
    pdf = pd.DataFrame(x, columns=["u", "v"]).assign(oid=np.arange(len(x)), label=(y > 0).astype(int))
    est = kernel.MarginSVC(gamma=10.0, C=5.0, numFeatures=2048)
    model = kernel.fit_columns(est, spark.createDataFrame(pdf), ["u", "v"], {"u": (0.0, 1.0), "v": (0.0, 1.0)})
    got = model.transform(spark.createDataFrame(pdf)).toPandas().sort_values("oid")["prediction"].to_numpy()
    want = exact_hinge(x, y, 10.0, 5.0) > 0
    assert (got == want).mean() > 0.98


def test_linear_split_is_the_squared_hinge_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (500, 2))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.05, 500) > 0.8, 1, 0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"]).assign(label=y))
    model = kernel.on_columns(kernel.MarginSVC(kernel="linear"), ["u", "v"]).fit(df)
    b, z, s = model.beta, np.column_stack([x, np.ones(500)]), np.where(y == 1, 1.0, -1.0)
    gradient = b - 2 * (z * (s * np.maximum(0, 1 - s * (z @ b)))[:, None]).sum(0)
    assert np.abs(gradient).max() < 1e-3


def test_a_hot_cell_counts_in_full(spark):
    rows = [(0, 0.2, 0.5)] * 3000 + [(1, 0.2, 0.5)] * 1000 + [(1, 0.8, 0.5)] * 50
    df = spark.createDataFrame(rows, "label int, u double, v double")
    est = kernel.on_columns(kernel.MarginSVC(gamma=20.0, C=1.0, numFeatures=256), ["u", "v"])
    cells = est._training_rows(df).toPandas()
    assert len(cells) == 3 and cells["_w"].sum() == 4050
    pred = est.fit(df).transform(df).groupBy("u").agg(F.max("prediction").alias("p")).collect()
    assert {r["u"]: r["p"] for r in pred} == {0.2: 0, 0.8: 1}


def test_any_estimator_fits(orbit_rows):
    df = labelled(orbit_rows)
    for est in (LogisticRegression(maxIter=5), RandomForestClassifier(numTrees=5, seed=1)):
        rows, report, _ = kernel.split_by_clf(est, ["w", "q"], df.filter("origin = 'gen'"), df.filter("origin = 'real'"))
        r = report.first()
        assert r["pha_in"] + r["nha_in"] + r["pha_out"] + r["nha_out"] == df.filter("origin = 'real'").count()
        assert rows.filter(F.col("w") > 1.5).count() > 0  # physical units again


def test_mask_and_meshes(spark, orbit_rows):
    df = orbit_rows.withColumn("in_domain", (F.col("q") < 0.7).cast("int"))
    cols = ["w", "q"]
    mask = kernel.domain_mask(
        kernel.MarginSVC(gamma=10.0, C=100.0, numFeatures=256), df, cols, scaling.bounds(df, cols)
    )
    ok = mask.transform(df).agg(F.avg((F.col("prediction") == F.col("in_domain")).cast("int"))).first()[0]
    assert ok > 0.97
    grid = grids.decision_grid(spark, mask.predict_unit, cols, 20, mask.scales)
    assert grid.count() == 400 and grid.filter("prediction is null").isEmpty()


def small_stage(name, cols, **more):
    return Stage(name, cols, lambda: kernel.MarginSVC(gamma=20.0, C=20.0, numFeatures=256), **more)


def test_cascade_keeps_every_row(orbit_rows):
    df = labelled(orbit_rows).withColumn("domain", F.lit(1))
    flows = [
        Flow(("apollo",), [small_stage("one", ["w", "q"]), small_stage("two", ["w", "q", "e"])]),
        Flow(("amor",), [small_stage("in", ["w", "q"], follow="inside"), small_stage("in-in", ["w", "q", "e"])]),
    ]
    out, models = cascade.run_cascade(df, flows)
    out = out.persist()
    assert set(models) == {"one", "two", "in", "in-in"}
    tags = quality.tagged_for_summary(df)
    assert out.count() == tags.count()
    assert {r["stage"] for r in out.select("stage").distinct().collect()} <= {None, "one", "two", "in-in"}
    s = quality.summary(out).filter("level = 3").collect()
    taken = out.filter("extracted").count()
    assert sum(r["extracted_pha"] + r["trapped_nha"] for r in s) == taken > 0
    assert out.filter("extracted and grp not in ('apollo', 'amor')").isEmpty()


def test_domain_settings_are_complete():
    names = [s.name for k in (1, 2, 3) for f in domains.flows(k) for s in f.stages]
    assert len(names) == len(set(names)) == 12
    assert domains.flows(4) == []


def test_kfold_covers_all_rows_once(orbit_rows):
    rows = crossval.kfold(LogisticRegression(maxIter=5), ["w", "q"], labelled(orbit_rows)).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2]


def test_classify_by_cluster(orbit_rows):
    df = labelled(orbit_rows)
    parts = df.withColumn("cluster_id", F.when(F.col("w") < 180, 1).otherwise(2))
    est = RandomForestClassifier(numTrees=5, seed=1)
    rows, share, _ = clusters.classify_by_cluster(parts, est, ["w", "q"], df)
    wrong = rows.filter((F.col("w") < 175) & (F.col("cluster_id") != 1)).count()
    assert wrong == 0 and share.count() == 2


def test_cascade_result_is_put_together_without_a_join(orbit_rows):
    df = labelled(orbit_rows).withColumn("domain", F.lit(1))
    flow = Flow(("apollo",), [small_stage("one", ["w", "q"], where=lambda: F.col("q") > 0.3)])
    out, _ = cascade.run_cascade(df, [flow])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert out.count() == quality.tagged_for_summary(df).count()
    assert out.filter("extracted and q <= 0.3").isEmpty()


def test_reports_of_domain_1_divide_by_all_its_rows(orbit_rows, monkeypatch):
    df = labelled(orbit_rows).withColumn("origin", F.when(F.col("oid") % 2 == 0, "gen").otherwise("real"))
    # an orbit beyond the limit that counts as hazardous makes the totals differ
    df = df.withColumn("label", F.when(F.col("q") > 1.2, 1).otherwise(F.col("label")))
    monkeypatch.setattr(domains, "flows", lambda domain, features: [Flow(("apollo",), [small_stage("one", ["w", "q"])])])
    out, report, _ = flows.mine_domain(df, 1)
    assert out.select("oid").distinct().count() == df.select("oid").distinct().count()
    assert out.filter("q > 1.066 and (extracted or grp is not null)").isEmpty()
    total = {r["origin"]: r["n"] for r in df.filter("label = 1").groupBy("origin").agg(F.count("*").alias("n")).collect()}
    seen = {(r["origin"], r["grp"]): r["n"] for r in out.filter("label = 1 and grp is not null").groupBy("origin", "grp").agg(F.count("*").alias("n")).collect()}
    assert df.filter("q > 1.066 and label = 1").count() > 0
    for r in report.collect():
        whole = seen[r["origin"], r["grp"]] if r["level"] == 0 and r["pha_fraction"] is not None else total[r["origin"]]
        if r["pha_fraction"] is not None:
            assert abs(r["pha_fraction"] - r["extracted_pha"] / whole) < 1e-12


def test_classify_by_many_clusters_and_unknown_features(orbit_rows):
    df = labelled(orbit_rows).limit(3000)
    parts = df.withColumn("cluster_id", 10 + F.floor(F.col("w") / 2.4).cast("int"))  # 150 ids
    est = RandomForestClassifier(numTrees=3, maxDepth=8, seed=1)
    some = df.withColumn("w", F.when(F.col("oid") % 3 != 0, F.col("w")))
    rows, _, model = clusters.classify_by_cluster(parts, est, ["w", "q"], some)
    assert rows.filter("w is null and cluster_id is not null").isEmpty()
    known = rows.filter("w is not null")
    assert known.filter("cluster_id not between 10 and 159").isEmpty() and known.filter("cluster_id is null").isEmpty()
    assert max(model.classes) > 100


def test_models_of_two_classes_after_an_observation(spark):
    rows = spark.createDataFrame([(k, k % 5 // 3, float(k % 5), float(k % 7)) for k in range(200)], "oid long, label int, w double, q double")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 200}
    for est in (LogisticRegression(maxIter=5), RandomForestClassifier(numTrees=3, seed=1)):
        got = {(r["label"], r["prediction"]) for r in kernel.split_by_clf(est, ["w", "q"], rows)[0].collect()}
        assert got == {(0, 0), (1, 1)}
    for ids in (1, 2):
        parts = rows.withColumn("cluster_id", F.when(F.col("w") < 2.5, 1).otherwise(ids))
        share = clusters.classify_by_cluster(parts, RandomForestClassifier(numTrees=3, seed=1), ["w", "q"], rows)[1]
        assert {r["cluster_id"]: r["n"] for r in share.collect()} == ({1: 200} if ids == 1 else {1: 120, 2: 80})


def test_bounds_leave_out_nan(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert scaling.bounds(rows, ["x"]) == {"x": (1.0, 3.0)}


def test_blocks_of_the_hessian_add_up(spark, orbit_rows, monkeypatch):
    from orbitsieve.operators import filters, kernel

    rows = filters.haz_by_moid(orbit_rows)
    fit = lambda: kernel.split_by_clf(kernel.MarginSVC(gamma=10.0, C=2.0, numFeatures=96), ["w", "q"], rows)[2].model
    whole = fit()
    monkeypatch.setattr(kernel, "HESS_ROWS", 7)
    parts = fit()
    assert whole.status == parts.status == "settled"
    assert np.allclose(whole.beta, parts.beta, rtol=1e-6, atol=1e-9)


def test_a_fit_that_does_not_settle_says_so(spark):
    from orbitsieve.operators import kernel

    rows = spark.createDataFrame([(1.0, 0.0, 1.0), (-1.0, 1.0, 1.0)], "_y double, x double, _w double")
    beta, status = kernel._newton(rows, ["x"], kernel._affine(), None, np.zeros(2), None, 0.0, rounds=1)
    assert status == "limit" and len(beta) == 2


def test_folds_together_equal_folds_one_by_one(spark, orbit_rows):
    from orbitsieve.operators import crossval, filters
    from orbitsieve.operators.centroid import CentroidClassifier

    rows = filters.haz_by_moid(orbit_rows).withColumn("fold", (F.col("oid") % 4).cast("int"))
    cols = ["w", "q", "e"]
    got = {r.fold: r.score for r in crossval.kfold(CentroidClassifier(), cols, rows, 4, fold=F.col("fold")).collect()}
    for k in range(4):
        alone = crossval.fit_predict(CentroidClassifier(), cols, rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k))[1].first()
        assert got[k] == alone.score
