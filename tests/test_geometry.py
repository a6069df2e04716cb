import math

import numpy as np
from pyspark.sql import functions as F

from orbitsieve import constants as K
from orbitsieve.functions import orbital as O
from orbitsieve.operators import geometry
from orbitsieve.operators.moid import append_moid, moid, moid_coarse


def norm(p):
    return F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])


def test_orbit_ends(orbit_rows):
    df = orbit_rows.select(
        "q",
        O.aphelion().alias("far"),
        norm(O.orbit_point(F.lit(0.0))).alias("p0"),
        norm(O.orbit_point(F.lit(math.pi))).alias("p1"),
    )
    assert df.filter((F.abs(F.col("q") - F.col("p0")) > 1e-9) | (F.abs(F.col("far") - F.col("p1")) > 1e-9)).isEmpty()


def test_center_is_between_the_ends(orbit_rows):
    p0, p1, c = O.orbit_point(F.lit(0.0)), O.orbit_point(F.lit(math.pi)), O.orbit_center()
    gap = sum((F.abs((p0[k] + p1[k]) / 2 - c[k]) for k in "xyz"), F.lit(0.0))
    assert orbit_rows.filter(gap > 1e-9).isEmpty()
    assert "rasc" in geometry.with_orbit_columns(orbit_rows).columns


def test_rings(spark):
    assert geometry.earth_ring(spark, 100).count() == 100
    r = geometry.unit_circle(spark).select((F.col("x") ** 2 + F.col("y") ** 2).alias("r")).toPandas()["r"]
    assert np.allclose(r, 1)


def points(a, e, i, w, om, t):
    r = a * (1 - e * e) / (1 + e * np.cos(t))
    u = t + w
    return np.stack(
        [
            r * (np.cos(om) * np.cos(u) - np.sin(om) * np.sin(u) * np.cos(i)),
            r * (np.sin(om) * np.cos(u) + np.cos(om) * np.sin(u) * np.cos(i)),
            r * np.sin(u) * np.sin(i),
        ]
    )


def brute_moid(a, e, i, w, om):
    i, w, om = map(math.radians, (i, w, om))
    ta, te = np.meshgrid(np.linspace(0, 2 * math.pi, 361), np.linspace(0, 2 * math.pi, 361), indexing="ij")
    earth = (K.EARTH_A, K.EARTH_E, 0.0, math.radians(K.EARTH_W), math.radians(K.EARTH_OM))
    dist = lambda s, t: np.sqrt(((points(a, e, i, w, om, s) - points(*earth, t)) ** 2).sum(0))
    d = dist(ta, te)
    inner = d[1:-1, 1:-1]
    low = np.ones_like(inner, bool)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            low &= inner <= d[1 + dx : 360 + dx, 1 + dy : 360 + dy]
    best = d.min()
    starts = list(zip(*np.nonzero(low))) + [tuple(x - 1 for x in np.unravel_index(d.argmin(), d.shape))]
    for x, y in starts:
        s, t, h = ta[x + 1, y + 1], te[x + 1, y + 1], 2 * math.pi / 360
        for _ in range(60):
            ss, tt = np.meshgrid(s + np.linspace(-h, h, 9), t + np.linspace(-h, h, 9), indexing="ij")
            dd = dist(ss, tt)
            k = np.unravel_index(dd.argmin(), dd.shape)
            s, t, h = ss[k], tt[k], h * 0.6
        best = min(best, dd.min())
    return min(best, K.MOID_CEILING)


def test_moid_against_brute_force(spark, orbit_rows):
    rows = append_moid(orbit_rows).orderBy("oid").toPandas().iloc[::60]
    for r in rows.itertuples():
        assert abs(r.moid - brute_moid(r.a, r.e, r.i, r.w, r.om)) < 1e-7


def test_moid_special_orbits(spark):
    schema = "oid long, a double, e double, i double, w double, om double"
    df = spark.createDataFrame(
        [(1, 2.0, 0.0, 0.0, 0.0, 0.0), (2, 30.0, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 1.2, 0.0, 0.0, 0.0),
         (4, 1.0, None, 0.0, 0.0, 0.0), (5, K.EARTH_A, K.EARTH_E, K.EARTH_I, K.EARTH_W, K.EARTH_OM)],
        schema,
    )
    got = {r["oid"]: r["moid"] for r in append_moid(df).collect()}
    assert abs(got[1] - 1.0) < 0.02
    assert got[2] == K.MOID_CEILING
    assert got[3] is None and got[4] is None
    assert got[5] < 1e-9


def test_moid_is_below_the_coarse_one(orbit_rows):
    both = orbit_rows.withColumn("d", moid()).join(moid_coarse(orbit_rows), "oid")
    assert both.filter(F.col("d") > F.col("moid_coarse") + 1e-9).isEmpty()


def test_moid_does_not_shuffle(orbit_rows, spark, sf):
    plan = append_moid(spark.read.parquet(f"{sf}/lineitem.parquet").select(
        *[F.lit(1.0).alias(c) for c in ("a", "e", "i", "w", "om")]
    ))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_solved_minima_leave_the_work(monkeypatch):
    """A minimum that has settled isn't polished on for the slowest one, and orbits don't depend on their batch."""
    from orbitsieve.operators import moid as solver

    rng = np.random.default_rng(4)
    n = 400
    q, e = rng.uniform(0.2, 1.3, n), rng.uniform(0.0, 0.9, n)
    orbit = [q / (1 - e), e, *(np.radians(rng.uniform(0, x, n)) for x in (60, 360, 360))]
    sizes, hypot = [], np.hypot
    monkeypatch.setattr(np, "hypot", lambda x, y: x.ndim == 1 and sizes.append(x.size) or hypot(x, y))
    together = solver._solve(*orbit)
    assert sizes[-1] < sizes[0] / 2
    alone = np.concatenate([solver._solve(*(x[k : k + 1] for x in orbit)) for k in range(0, n, 20)])
    assert np.allclose(together[::20], alone, rtol=0, atol=1e-12)
