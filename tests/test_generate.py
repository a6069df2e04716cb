import numpy as np
from pyspark.sql import functions as F

from orbitsieve import constants as K
from orbitsieve.operators import distributions as D, generate


def ks(a, b):
    both = np.sort(np.concatenate([a, b]))
    side = lambda x: np.searchsorted(np.sort(x), both, side="right") / len(x)
    return np.abs(side(a) - side(b)).max()


def test_normal_fit_finds_its_parameters(spark):
    df = spark.range(0, 40000, 1, 4).select((F.randn(5) * 2 + 30).alias("x"))
    d = D.fit_distributions(df, {"x": "normal"}, 40)["x"]
    assert abs(d.params["loc"] - 30) < 0.1 and abs(d.params["scale"] - 2) < 0.1 and d.sse < 1e-3


def test_families_fit_their_own_shape(spark):
    u = F.rand(3)
    df = spark.range(0, 40000, 1, 4).select(
        u.alias("u"), F.randn(4).alias("z"), F.rand(6).alias("v"), F.rand(8).alias("k")
    ).select(
        (1 / (1 + F.exp(-(F.col("z") - 1) / 1.5)) * 8 + 0.5).alias("sb"),
        (F.pow(-F.ln(1 - F.col("u")), F.lit(1 / 1.8)) * 20 + 1).alias("wb"),
        F.when(F.col("k") < 0.5, F.col("z") * 25 + 90).otherwise(F.col("z") * 25 + 270).alias("two"),
        (-F.ln(F.col("u")) - F.ln(F.col("v")) + 1).alias("g"),
    )
    fitted = D.fit_distributions(df, {"sb": "johnsonsb", "wb": "exponweib", "two": "bimodal", "g": "pearson3"}, 30)
    draws = D.draws(spark, 20000, fitted).toPandas()
    data = df.toPandas()
    for c in ("sb", "wb", "two", "g"):
        assert ks(draws[c].to_numpy(), data[c].to_numpy()) < 0.05, c


def test_harmonic_fit_is_closed_form(spark):
    # Density (1 + 0.5 sin(2x + 1)) / 360 by rejection.
    df = spark.range(0, 120000, 1, 4).select((F.rand(1) * 360).alias("w"), F.rand(2).alias("r"))
    df = df.filter(F.col("r") * 1.5 < 1 + 0.5 * F.sin(2 * F.radians("w") + 1)).persist()
    d = D.fit_distributions(df, {"w": "harmonic"}, 50)["w"]
    assert abs(d.params["phase"] - 1) < 0.1 and abs(d.params["amp"] * 360 - 0.5) < 0.05
    draws = D.draws(spark, 20000, {"w": d}).toPandas()["w"].to_numpy()
    assert ks(draws, df.select("w").toPandas()["w"].to_numpy()) < 0.02


def test_draws_stay_in_bounds_and_repeat(spark, orbit_rows):
    fitted = D.fit_distributions(orbit_rows, {"q": "pearson3", "i": "exponweib"}, 25)
    one, two = (D.draws(spark, 5000, fitted, seed=9).orderBy("oid").toPandas() for _ in range(2))
    assert one.equals(two)
    for c, d in fitted.items():
        assert one[c].between(d.lo, d.hi).all()


def test_kde_draws_follow_the_data(spark, orbit_rows):
    d = D.kde_distribution(orbit_rows, "q")
    draws = D.draws(spark, 20000, {"q": d}).toPandas()["q"].to_numpy()
    data = orbit_rows.select("q").toPandas()["q"].to_numpy()
    noise = np.random.default_rng(1).normal(0, d.params["bandwidth"], len(data))
    assert ks(draws, data + noise) < 0.03


def test_orbits_are_exactly_as_many_and_closed(spark, orbit_rows):
    fitted = D.fit_distributions(orbit_rows, n=25)
    out = generate.gen_orbits(spark, fitted, 20000).toPandas()
    assert len(out) == 20000
    assert ((out["e"] > 0) & (out["e"] < 1)).all()
    assert np.allclose(out["e"], (out["a"] - out["q"]) / out["a"])
    # The same law as redrawing until the orbit is closed.
    raw = D.draws(spark, 200000, {k: fitted[k] for k in ("a", "q")}, seed=3).toPandas()
    kept = raw[raw["q"] < raw["a"]]
    for c in ("a", "q"):
        assert ks(out[c].to_numpy(), kept[c].to_numpy()) < 0.02


def test_raw_orbits_use_fixed_bounds(spark):
    out = generate.gen_orbits_raw(spark, 5000).toPandas()
    for c, (lo, hi) in K.UNIFORM_BOUNDS.items():
        assert out[c].between(lo, hi).all()
    assert {"e", "per"} <= set(out.columns)


def test_inout_orbits_follow_their_side(spark):
    flat = D.uniform_distributions({"q": (0.2, 1.3), "e": (0.0, 1.1), "w1": (0.0, 90.0), "w2": (180.0, 360.0)})
    out = generate.gen_orbits_inout(
        spark, {"q": flat["q"], "e": flat["e"]}, flat["w1"], flat["w2"], 5000
    ).toPandas()
    inner = out["q"] <= 1.0
    assert (out["w"][inner] <= 90).all() and (out["w"][~inner] >= 180).all()
    assert (out["e"] < 1).all() and (out["e"] == 0.99).mean() > 0.05
    assert np.allclose(out["a"], out["q"] / (1 - out["e"]))


def test_flow_from_catalog_to_reports(spark, orbit_rows, tmp_path):
    from orbitsieve.plans import flows

    rules = [F.col("q") > 0.9, F.col("q") > 0.3]
    saved = flows.mine_neas(orbit_rows, 3000, rules, str(tmp_path / "neas"))
    real = flows.near_earth(orbit_rows).count()
    count = {r["origin"]: r["count"] for r in saved.groupBy("origin").count().collect()}
    assert count == {"gen": 3000, "real": real}
    assert saved.filter("domain = 0 and q > 0.3").isEmpty() and saved.filter("moid is null").isEmpty()
    out, summary, models = flows.mine_domain(saved.filter("domain = 1"), 4)
    assert not models and out.filter("not extracted").isEmpty()
    top = summary.filter("level = 3").collect()
    assert all(r["pha_fraction"] in (1.0, None) for r in top)


def test_distance_search_is_fine_enough(spark):
    """Near-tangent and near-coplanar orbits have close minima; a finer search finds nothing lower."""
    from orbitsieve.operators import moid

    rng = np.random.default_rng(8)
    n = 3000
    e, q = rng.uniform(0, 0.99, n), rng.uniform(0.98, 1.02, n)
    rows = [q / (1 - e), e, np.radians(rng.exponential(1.0, n)), rng.uniform(0, 6.28, n), rng.uniform(0, 6.28, n)]
    fast = moid._solve(*rows)
    old, moid.GRID = moid.GRID, 1024
    try:
        assert np.abs(fast - moid._solve(*rows)).max() < 1e-9
    finally:
        moid.GRID = old


def test_uniforms_are_independent_of_each_other_and_of_partitions(spark):
    from orbitsieve.operators.distributions import uniform_rows

    names = ["a", "e", "i"]
    rows = uniform_rows(spark, 120_000, names, 7)
    assert rows.rdd.getNumPartitions() > 1
    pdf = rows.toPandas().set_index("oid").sort_index()
    assert len(set(pdf.to_numpy().reshape(-1).tolist())) == 360_000
    assert abs(pdf.corr().to_numpy() - [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).max() < 0.02
    assert ((pdf >= 0) & (pdf < 1)).all().all()
    again = uniform_rows(spark, 1_000, names, 7).repartition(3).toPandas().set_index("oid").sort_index()
    assert (again == pdf.loc[:999]).all().all()


def test_a_family_of_the_user_and_a_mixture_fit(spark):
    from orbitsieve.functions.pdfs import FAMILIES, Family, mixture

    laplace = Family(
        ("loc", "scale"), lambda x, loc, scale: F.exp(-F.abs(x - loc) / scale) / (2 * scale),
        lambda m: [{"loc": m.mean, "scale": m.std}], ("scale",),
    )
    u = F.rand(3) - 0.5
    df = spark.range(0, 40000, 1, 4).select(
        (F.lit(12.0) - 1.5 * F.signum(u) * F.ln(1 - 2 * F.abs(u))).alias("x"),
        F.when(F.rand(5) < 0.25, F.randn(6) * 0.5 + 3).otherwise(F.randn(7) * 1.5 + 9).alias("y"),
    ).filter("x > 0 and y > 0")
    fitted = D.fit_distributions(df, {"x": laplace, "y": mixture(FAMILIES["normal"], FAMILIES["normal"])}, 80)
    x, y = fitted["x"], fitted["y"]
    assert abs(x.params["loc"] - 12) < 0.1 and abs(x.params["scale"] - 1.5) < 0.1 and x.status == "settled"
    got = [(y.params[f"loc_{k}"], y.params[f"scale_{k}"]) for k in (1, 2)]
    assert np.allclose(sorted(got), [(3, 0.5), (9, 1.5)], atol=0.15)
    share = y.params["share_1"] if y.params["loc_1"] < 6 else 1 - y.params["share_1"]
    assert abs(share - 0.25) < 0.03
    draws = D.draws(spark, 20000, fitted).toPandas()
    data = df.toPandas()
    assert all(ks(draws[c].to_numpy(), data[c].to_numpy()) < 0.02 for c in "xy")


def test_tails_follow_the_density(spark):
    """Shares down to a hundred-thousandth, of a smooth density, one with a deep gap and one with a pole."""
    from math import erf

    from orbitsieve.functions.pdfs import FAMILIES, mixture

    phi = lambda z: (1 + erf(z / 2**0.5)) / 2
    normal = FAMILIES["normal"]
    gap = {"share_1": 0.5, "loc_1": -8.0, "scale_1": 0.2, "loc_2": 8.0, "scale_2": 0.2}
    shares = [1e-5, 1e-4, 1e-3, 0.3, 0.499, 0.501, 0.9, 0.999, 0.9999, 0.99999]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(shares)], "k int, s double")
    cases = [
        (D.given(spark, "x", normal, {"loc": 0.0, "scale": 1.0}, -6.0, 6.0), phi),
        (D.given(spark, "x", "exponweib", {"a": 2.0, "c": 0.9, "loc": 0.0, "scale": 1.0}, 0.0, 30.0), lambda x: (1 - np.exp(-(x**0.9))) ** 2),
        (D.given(spark, "x", mixture(normal, normal), gap, -10.0, 10.0), lambda x: (phi((x + 8) / 0.2) + phi((x - 8) / 0.2)) / 2),
    ]
    for d, cdf in cases:
        got = rows.select("k", D.quantile(d, F.col("s")).alias("x")).withColumn("back", D.share_below(d, F.col("x"))).toPandas().sort_values("k")
        lo, hi = cdf(d.lo), cdf(d.hi)
        assert np.allclose([(cdf(x) - lo) / (hi - lo) for x in got["x"]], shares, rtol=1e-4, atol=1e-9)
        assert np.allclose(got["back"], shares, rtol=1e-3, atol=1e-7)
    pole = D.given(spark, "x", "exponweib", {"a": 0.4, "c": 0.9, "loc": 0.0, "scale": 1.0}, 0.0, 30.0)
    got = rows.select("k", D.quantile(pole, F.col("s")).alias("x")).toPandas().sort_values("k")["x"]
    whole = (1 - np.exp(-(30**0.9))) ** 0.4
    assert np.allclose(got, (-np.log(1 - (np.array(shares) * whole) ** 2.5)) ** (1 / 0.9), atol=1e-6) and (got > 0).all()


def test_uniforms_are_the_same_in_sql(spark):
    import duckdb

    from orbitsieve.functions.uniforms import uniform_sql, with_uniforms

    rows = spark.range(5000).selectExpr("id * 918273645546 - 77 AS oid")
    got = with_uniforms(rows, 3, {"u": "q"}).toPandas()
    want = duckdb.sql(f"SELECT oid, {uniform_sql(3, 'q')} AS u FROM (SELECT range * 918273645546 - 77 AS oid FROM RANGE(5000))").df()
    assert got["oid"].tolist() == want["oid"].tolist() and got["u"].tolist() == want["u"].tolist()


def test_too_narrow_a_kernel_is_refused(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    with np.testing.assert_raises(ValueError):
        D.kde_distribution(df, "x", 1e-7)
