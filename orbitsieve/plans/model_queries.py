"""Registered queries on generation, classifiers, clusters and meshes.

Those driven by random numbers or by an iterative fit have no SQL; tests check them against brute
force and by their properties.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ..operators import (
    augment, cascade, clusters, crossval, dbscan as db, density, distributions, filters, generate, grids,
    kernel, quality, scaling,
)
from ..operators.centroid import CentroidClassifier
from ..functions.pdfs import FAMILIES, mixture
from ..functions.uniforms import uniform_sql
from ..scratch import written
from ..sources.fixture import orbits
from . import domains, flows
from .queries import (
    LABEL_MOID, LABELLED, TAGS, _DM_VALUES, _bounds_cte, labelled_orbits, query, r6, rounded, rule_clusters, sql, _cluster_sql, _hist_sql,
)



def recursive(text: str) -> str:
    return text.replace("WITH orbits", "WITH RECURSIVE orbits", 1)


# --- virtual orbits --------------------------------------------------------------------------


def _real(spark, sf):
    return orbits(spark, sf).filter(F.col("origin") == "real")


@query("fit_distributions")
def fit_distributions(spark, sf):
    fitted = distributions.fit_distributions(_real(spark, sf), n=25)
    rows = [(d.name, d.family_name, p, float(v), d.sse, d.status) for d in fitted.values() for p, v in d.params.items()]
    return spark.createDataFrame(rows, "name string, family string, param string, value double, sse double, status string")


_LATTICE = 200


@query(
    "normal_fit",
    sql(
        "SELECT CAST(j AS INTEGER) AS loc_step, CAST(k AS INTEGER) AS scale_step, 'settled' AS status FROM ("
        "SELECT j, k, SUM(POW(EXP(-POW((center-loc)/scale,2)/2)/(scale*SQRT(2*PI())) - density, 2)) AS miss "
        "FROM bins, (SELECT j, k, lo + j*(hi-lo)/" + str(_LATTICE) + " AS loc, k*(hi-lo)/" + str(_LATTICE) + " AS scale "
        f"FROM lim, (SELECT UNNEST(RANGE({_LATTICE})) AS j), (SELECT UNNEST(RANGE(1, {_LATTICE})) AS k)) GROUP BY j, k) ORDER BY miss LIMIT 1",
        "r AS (SELECT a FROM orbits WHERE origin = 'real')", "lim AS (SELECT MIN(a) AS lo, MAX(a) AS hi FROM r)",
        "bins AS MATERIALIZED (" + _hist_sql("r", "a", 50).replace("ROUND(", "((").replace(", 6) + 0e0", "))") + ")",
    ),
)
def normal_fit(spark, sf):
    """Least-squares normal density of a, as steps of a lattice over its range."""
    d = distributions.fit_distributions(_real(spark, sf), {"a": "normal"})["a"]
    step = (d.hi - d.lo) / _LATTICE
    row = (round((d.params["loc"] - d.lo) / step), round(d.params["scale"] / step), d.status)
    return spark.createDataFrame([row], "loc_step int, scale_step int, status string")


def _wave_parts(col: str, src: str = "r") -> str:
    """SELECT of a, b, c: least squares of a sin 2x + b cos 2x + c over the histogram by Cramer's rule."""
    m = [["ss", "sc", "s"], ["sc", "cc", "c"], ["s", "c", "n"]]
    det = lambda r: (
        f"({r[0][0]}*({r[1][1]}*{r[2][2]}-{r[1][2]}*{r[2][1]})-{r[0][1]}*({r[1][0]}*{r[2][2]}-{r[1][2]}*{r[2][0]})"
        f"+{r[0][2]}*({r[1][0]}*{r[2][1]}-{r[1][1]}*{r[2][0]}))"
    )
    put = lambda k: [[y if j == k else v for j, v in enumerate(row)] for row, y in zip(m, ("sy", "cy", "sum_y"))]
    a, b, c = (f"{det(put(k))}/{det(m)}" for k in range(3))
    bins = _hist_sql(src, col, 50)
    # The histogram query rounds for its own report; here the full density is needed.
    bins = bins.replace("ROUND(", "((").replace(", 6) + 0e0", "))")
    return (
        f"SELECT {a} AS a, {b} AS b, {c} AS c FROM ("
        "SELECT SUM(s*s) AS ss, SUM(s*c) AS sc, SUM(c*c) AS cc, SUM(s) AS s, SUM(c) AS c, COUNT(*)*1e0 AS n, SUM(s*y) AS sy, SUM(c*y) AS cy, SUM(y) AS sum_y "
        f"FROM (SELECT SIN(2*RADIANS(center)) AS s, COS(2*RADIANS(center)) AS c, density AS y FROM ({bins})))"
    )


def _wave_sql(col: str) -> str:
    return f"SELECT '{col}' AS name, {r6(amp='360*SQRT(POW(a,2)+POW(b,2))', phase='ATAN2(b, a)', shift='360*c')} FROM ({_wave_parts(col)})"


def _wave_ctes(p: str, col: str, src: str = "r") -> list[str]:
    """Parameters of a fitted wave on the column's range as ``{p}_w``."""
    at = lambda x: f"amp*90/PI()*(COS(phase)-COS(2*RADIANS({x})+phase))+shift*({x})"
    return [
        f"{p}_0 AS (SELECT SQRT(POW(a,2)+POW(b,2)) AS amp, ATAN2(b, a) AS phase, c AS shift, lo, hi FROM ({_wave_parts(col, src)}), (SELECT MIN({col}) AS lo, MAX({col}) AS hi FROM {src}))",
        f"{p}_w AS (SELECT *, {at('lo')} AS f0, {at('hi')} AS f1 FROM {p}_0)",
    ]


def _wave_draw(p: str, u: str, rows: str, name: str) -> str:
    """SELECT of all columns of ``rows`` and the place below which the share ``u`` of a wave lies, by Newton steps."""
    at, slope = "amp*90/PI()*(COS(phase)-COS(2*RADIANS(x)+phase))+shift*x", "amp*SIN(2*RADIANS(x)+phase)+shift"
    inner = f"(SELECT r.*, amp, phase, shift, f0, f1, lo + ({u})*(hi-lo) AS x FROM {rows} r, {p}_w)"
    for _ in range(9):
        inner = f"(SELECT * REPLACE (x - (({at}) - f0 - ({u})*(f1-f0)) / ({slope}) AS x) FROM {inner})"
    return f"SELECT * EXCLUDE (amp, phase, shift, f0, f1, x), x AS {name} FROM {inner}"


def _uniforms(*names: str) -> str:
    """CTE ``u``: as many keys as real orbits, with a uniform draw for each name."""
    return "u AS (SELECT oid, " + ", ".join(f"{uniform_sql(7, c)} AS r_{c}" for c in names) + " FROM (SELECT UNNEST(RANGE((SELECT COUNT(*) FROM r))) AS oid))"


_REAL = "r AS (SELECT * FROM orbits WHERE origin = 'real')"


def r4(**cols: str) -> str:
    return ", ".join(f"ROUND({e}, 4) + 0e0 AS {n}" for n, e in cols.items())


def rounded4(df):
    return df.select(*[F.round(f.name, 4).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query(
    "harmonic_fit",
    sql(
        f"{_wave_sql('w')} UNION ALL {_wave_sql('om')}",
        "r AS (SELECT w, om FROM orbits WHERE origin = 'real')",
    ),
)
def harmonic_fit(spark, sf):
    fitted = distributions.fit_distributions(_real(spark, sf), {"w": "harmonic", "om": "harmonic"})
    rows = [(d.name, 360 * d.params["amp"], d.params["phase"], 360 * d.params["shift"]) for d in fitted.values()]
    return rounded(spark.createDataFrame(rows, "name string, amp double, phase double, shift double"))


@query(
    "harmonic",
    sql(
        f"SELECT oid, {r4(w='w', om='om')} FROM d2",
        _REAL, *_wave_ctes("w", "w"), *_wave_ctes("om", "om"), _uniforms("w", "om"),
        f"d1 AS ({_wave_draw('w', 'r_w', 'u', 'w')})", f"d2 AS ({_wave_draw('om', 'r_om', 'd1', 'om')})",
    ),
)
def harmonic(spark, sf):
    df = _real(spark, sf)
    fitted = distributions.fit_distributions(df, {"w": "harmonic", "om": "harmonic"})
    return rounded4(distributions.draws(spark, df.count(), fitted))


@query("bimodal")
def bimodal(spark, sf):
    df = _real(spark, sf)
    fitted = distributions.fit_distributions(df, {"w": "bimodal"})
    return distributions.draws(spark, df.count(), fitted)


_DRAW_BINS = 50


def _binned(draws, col, lo, hi):
    slot = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / _DRAW_BINS)), F.lit(_DRAW_BINS - 1)).cast("int")
    return draws.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def _binned_sql(name: str, pdf: str, ctes: list[str], limits: str, cells: int) -> str:
    """How many uniform draws fall between the shares below the edges of bins; shares by Simpson's rule over ``pdf`` of x."""
    return sql(
        "SELECT CAST(k - 1 AS INTEGER) AS bin, COUNT(*) AS n FROM (SELECT oid, (SELECT COUNT(*) FROM edges WHERE share <= d.r_x) + 1 AS k FROM u d) GROUP BY 1",
        *ctes,
        f"lim AS ({limits})",
        f"nodes AS (SELECT i, lo + i*(hi-lo)/{2 * cells * _DRAW_BINS} AS x FROM lim, (SELECT UNNEST(RANGE({2 * cells * _DRAW_BINS + 1})) AS i))",
        f"dens AS MATERIALIZED ({pdf})",
        f"parts AS (SELECT i // {2 * cells} AS bin, SUM(f * CASE WHEN i % 2 = 1 THEN 4 WHEN i % {2 * cells} = 0 THEN 1 ELSE 2 END) AS s FROM dens WHERE i < {2 * cells * _DRAW_BINS} GROUP BY 1)",
        f"whole AS (SELECT p.bin, s + f AS s FROM parts p JOIN dens d ON d.i = (p.bin + 1) * {2 * cells})",
        f"edges AS MATERIALIZED (SELECT * FROM (SELECT bin, SUM(s) OVER (ORDER BY bin) / SUM(s) OVER () AS share FROM whole) WHERE bin < {_DRAW_BINS - 1})",
        "u AS (SELECT " + uniform_sql(7, name) + " AS r_x, oid FROM (SELECT UNNEST(RANGE((SELECT COUNT(*) FROM r))) AS oid))",
    )


@query(
    "bimodal_draws",
    _binned_sql(
        "w",
        "SELECT i, 0.3e0*EXP(-POW((x-m1)/s1,2)/2)/s1 + 0.7e0*EXP(-POW((x-m2)/s2,2)/2)/s2 AS f FROM nodes, lim",
        [_REAL],
        "SELECT MIN(w) AS lo, MAX(w) AS hi, AVG(w)-STDDEV_SAMP(w) AS m1, AVG(w)+STDDEV_SAMP(w) AS m2, STDDEV_SAMP(w)/5 AS s1, STDDEV_SAMP(w)/2 AS s2 FROM r",
        40,
    ),
)
def bimodal_draws(spark, sf):
    """Draws from two normal densities with unequal shares and widths, cut to the data's range."""
    df = _real(spark, sf)
    n, lo, hi, mean, std = df.agg(F.count("*"), F.min("w"), F.max("w"), F.avg("w"), F.stddev_samp("w")).first()
    normal = FAMILIES["normal"]
    params = {"share_1": 0.3, "loc_1": mean - std, "scale_1": std / 5, "loc_2": mean + std, "scale_2": std / 2}
    d = distributions.given(spark, "w", mixture(normal, normal), params, lo, hi)
    return _binned(distributions.draws(spark, n, {"w": d}), "w", lo, hi)


@query(
    "kde_draws",
    _binned_sql(
        "q",
        "SELECT nodes.i, SUM(EXP(-POW((x-q)/bw,2)/2)) AS f FROM nodes, lim, r GROUP BY nodes.i",
        [_REAL],
        "SELECT MIN(q)-9*bw AS lo, MAX(q)+9*bw AS hi, MIN(bw) AS bw FROM r, (SELECT STDDEV_SAMP(q)*POW(COUNT(*), -0.2e0) AS bw FROM r) GROUP BY bw",
        12,
    ),
)
def kde_draws(spark, sf):
    df = _real(spark, sf)
    d = distributions.kde_distribution(df, "q")
    return _binned(distributions.draws(spark, df.count(), {"q": d}), "q", d.lo, d.hi)


@query(
    "truncated_draws",
    sql(
        "SELECT oid, " + r4(i="lo + sd*POW(-LN(1-POW(r_i*POW(1-EXP(-POW((hi-lo)/sd, 1.2e0)), 1.5e0), 1/1.5e0)), 1/1.2e0)") + " FROM u, lim",
        _REAL, "lim AS (SELECT MIN(i) AS lo, MAX(i) AS hi, STDDEV_SAMP(i) AS sd FROM r)", _uniforms("i"),
    ),
)
def truncated_draws(spark, sf):
    """Exponentiated Weibull draws cut to the data's range, tails included."""
    df = _real(spark, sf)
    n, lo, hi, std = df.agg(F.count("*"), F.min("i"), F.max("i"), F.stddev_samp("i")).first()
    d = distributions.given(spark, "i", "exponweib", {"a": 1.5, "c": 1.2, "loc": lo, "scale": std}, lo, hi)
    return rounded4(distributions.draws(spark, n, {"i": d}))


@query("kde_sampler")
def kde_sampler(spark, sf):
    df = _real(spark, sf)
    return distributions.draws(spark, df.count(), {"q": distributions.kde_distribution(df, "q")})


_KDE_POINTS = 101


@query(
    "kde_pdf",
    sql(
        f"SELECT CAST(k AS INTEGER) AS k, {r6(x='MIN(x)', density='SUM(EXP(-POW(q-x,2)/(2*bw*bw)))/(MIN(n)*SQRT(2*PI())*MIN(bw))')} FROM g, r GROUP BY k",
        "r AS (SELECT q FROM orbits WHERE origin = 'real')",
        "p AS (SELECT MIN(q) AS lo, MAX(q) AS hi, COUNT(*) AS n, STDDEV_SAMP(q)*POW(COUNT(*), -0.2e0) AS bw FROM r)",
        f"g AS (SELECT k, lo+k*(hi-lo)/{_KDE_POINTS - 1} AS x, n, bw FROM p, (SELECT UNNEST(RANGE(0, {_KDE_POINTS})) AS k))",
    ),
)
def kde_pdf(spark, sf):
    return rounded(density.kde_pdf(_real(spark, sf), "q", _KDE_POINTS))


@query("truncated_sample")
def truncated_sample(spark, sf):
    df = _real(spark, sf)
    fitted = distributions.fit_distributions(df, {"q": "pearson3", "i": "exponweib"})
    return distributions.draws(spark, df.count(), fitted)


@query("gen_orbits")
def gen_orbits(spark, sf):
    df = _real(spark, sf)
    return generate.gen_orbits(spark, distributions.fit_distributions(df, n=25), df.count())


@query(
    "gen_orbits_flat",
    sql(
        f"SELECT CAST(LEAST(FLOOR((a-a0)/((a1-a0)/{_DRAW_BINS})), {_DRAW_BINS - 1}) AS INTEGER) AS abin, CAST(FLOOR(20*q/a) AS INTEGER) AS qbin, COUNT(*) AS n FROM drawn GROUP BY 1, 2",
        _REAL, "lim AS (SELECT MIN(a) AS a0, MAX(a) AS a1, MIN(q) AS q0, MAX(q) AS q1 FROM r)", _uniforms("a", "q"),
        # a has density 0 up to q0, rises in a straight line up to q1 and is flat beyond
        "area AS (SELECT *, GREATEST(a0, q0) AS s, POW(q1-q0, 2)/2 - POW(GREATEST(a0, q0)-q0, 2)/2 AS slope, (a1-q1)*(q1-q0) AS flat FROM lim)",
        "drawn AS (SELECT *, q0 + r_q*LEAST(a-q0, q1-q0) AS q FROM (SELECT u.*, a0, a1, q0, q1, CASE WHEN r_a*(slope+flat) <= slope THEN q0 + SQRT(2*r_a*(slope+flat) + POW(s-q0, 2)) ELSE q1 + (r_a*(slope+flat)-slope)/(q1-q0) END AS a FROM u, area))",
    ),
)
def gen_orbits_flat(spark, sf):
    """Closed orbits from flat densities of a and q, counted by a and q / a."""
    df = _real(spark, sf)
    limits = scaling.bounds(df, ["a", "q"])
    out = generate.gen_orbits(spark, distributions.uniform_distributions(limits), df.count())
    lo, hi = limits["a"]
    abin = F.least(F.floor((F.col("a") - lo) / ((hi - lo) / _DRAW_BINS)), F.lit(_DRAW_BINS - 1)).cast("int")
    return out.groupBy(abin.alias("abin"), F.floor(20 * F.col("q") / F.col("a")).cast("int").alias("qbin")).agg(F.count("*").alias("n"))


_FLAT = ("a", "i", "w", "om", "q")


@query(
    "gen_orbits_raw",
    sql(
        f"SELECT oid, {r6(a='a', i='i', w='w', om='om', q='q', e='(a-q)/a', per='2*PI()*SQRT(POW(a*149597870700e0, 3)/(6.67384e-11*1.989e30))/86400')} FROM d",
        _REAL, "lim AS (SELECT " + ", ".join(f"MIN({c}) AS {c}0, MAX({c}) AS {c}1" for c in _FLAT) + " FROM r)", _uniforms(*_FLAT),
        "d AS (SELECT oid, " + ", ".join(f"{c}0 + r_{c}*({c}1-{c}0) AS {c}" for c in _FLAT) + " FROM u, lim)",
    ),
)
def gen_orbits_raw(spark, sf):
    df = _real(spark, sf)
    limits = scaling.bounds(df, ["a", "i", "w", "om", "q"])
    return rounded(generate.gen_orbits_raw(spark, df.count(), distributions.uniform_distributions(limits)))


@query(
    "gen_orbits_inout",
    sql(
        f"SELECT oid, {r4(q='q', e='e', w='w', a='q/(1-e)')} FROM (SELECT * REPLACE (CASE WHEN e >= 1 THEN 0.99e0 ELSE e END AS e), CASE WHEN q <= 1 THEN win ELSE wout END AS w FROM d2)",
        _REAL, "inside AS (SELECT w FROM r WHERE q <= 1)", "outside AS (SELECT w FROM r WHERE q > 1)",
        "lim AS (SELECT MIN(q) AS q0, MAX(q) AS q1, MIN(e) AS e0, MAX(e) AS e1 FROM r)", _uniforms("q", "e", "w"),
        *_wave_ctes("win", "w", "inside"), *_wave_ctes("wout", "w", "outside"),
        "d0 AS (SELECT oid, r_w, q0 + r_q*(q1-q0) AS q, e0 + r_e*(e1-e0) AS e FROM u, lim)",
        f"d1 AS ({_wave_draw('win', 'r_w', 'd0', 'win')})", f"d2 AS ({_wave_draw('wout', 'r_w', 'd1', 'wout')})",
    ),
)
def gen_orbits_inout(spark, sf):
    """Flat q and e; w from the wave fitted to the orbits inside the Earth's, or to those outside."""
    df = _real(spark, sf)
    common = distributions.uniform_distributions(scaling.bounds(df, ["q", "e"]))
    inner, outer = (
        distributions.fit_distributions(side, {"w": "harmonic"})["w"]
        for side in (df.filter(F.col("q") <= 1.0), df.filter(F.col("q") > 1.0))
    )
    return rounded4(generate.gen_orbits_inout(spark, common, inner, outer, df.count()))


@query("gen_orbits_inout_fitted")
def gen_orbits_inout_fitted(spark, sf):
    df = written(_real(spark, sf).select("q", "e", "i", "om", "w"), "real")  # seven passes read them
    common = distributions.fit_distributions(
        df, {"q": "pearson3", "e": "johnsonsb", "i": "exponweib", "om": "harmonic"}
    )
    inner, outer = (
        distributions.fit_distributions(side, {"w": "harmonic"})["w"]
        for side in (df.filter(F.col("q") <= 1.0), df.filter(F.col("q") > 1.0))
    )
    return generate.gen_orbits_inout(spark, common, inner, outer, df.count())


@query("virtual_orbits_labelled")
def virtual_orbits_labelled(spark, sf):
    """Fit, generate, compute the distance, label: the chain from a catalog to a training set."""
    df = _real(spark, sf)
    return flows.virtual_population(df, df.count())


# --- classifiers -----------------------------------------------------------------------------


def _moid_labelled(spark, sf):
    return filters.haz_by_moid(orbits(spark, sf))


def _report(predicted):
    return rounded(quality.split_quality(predicted, ["origin"]))


def _quality_sql(src: str) -> str:
    counts = {"pha_in": (1, 1), "nha_in": (0, 1), "pha_out": (1, 0), "nha_out": (0, 0)}
    tally = ", ".join(f"COUNT(*) FILTER (label = {y} AND prediction = {p}) AS {n}" for n, (y, p) in counts.items())
    shares = r6(
        pha_purity="pha_in*1e0/NULLIF(pha_in+nha_in, 0)", nha_purity="nha_out*1e0/NULLIF(pha_out+nha_out, 0)",
        recall="pha_in*1e0/NULLIF(pha_in+pha_out, 0)",
    )
    return f"SELECT *, {shares} FROM (SELECT origin, {tally} FROM {src} GROUP BY origin)"


_MOID_LABELLED = f"lab AS (SELECT *, {LABEL_MOID} AS label FROM orbits WHERE moid IS NOT NULL)"


def _det(r) -> str:
    return (
        f"({r[0][0]}*({r[1][1]}*{r[2][2]}-{r[1][2]}*{r[2][1]})-{r[0][1]}*({r[1][0]}*{r[2][2]}-{r[1][2]}*{r[2][0]})"
        f"+{r[0][2]}*({r[1][0]}*{r[2][1]}-{r[1][1]}*{r[2][0]}))"
    )


def _newton_ctes() -> list[str]:
    """Squared hinge in two columns and a constant: each Newton step solves for the rows inside the margin."""
    m = [["1+2*xx", "2*xy", "2*x"], ["2*xy", "1+2*yy", "2*y"], ["2*x", "2*y", "1+2*n"]]
    m = [[f"({v})" for v in row] for row in m]
    put = lambda k: [[r if j == k else v for j, v in enumerate(row)] for row, r in zip(m, ("2*xt", "2*yt", "2*t"))]
    b = ", ".join(f"{_det(put(k))}/{_det(m)}" for k in range(3))
    return [
        "grp AS (" + TAGS.format(src="lab") + ")",
        "rows AS (SELECT * FROM grp WHERE grp IN ('atira', 'aten'))",
        "sb AS (SELECT MIN(a) AS a0, MAX(a) AS a1, MIN(i) AS i0, MAX(i) AS i1 FROM rows)",
        "pts AS MATERIALIZED (SELECT origin, label, (a-a0)/(a1-a0) AS x, (i-i0)/(i1-i0) AS y, CASE WHEN label = 1 THEN 1e0 ELSE -1e0 END AS t FROM rows, sb)",
        "newton(step, b1, b2, b3) AS (SELECT 0, 0e0, 0e0, 0e0 UNION ALL SELECT step + 1, " + b + " FROM ("
        "SELECT step, SUM(x*x) AS xx, SUM(x*y) AS xy, SUM(y*y) AS yy, SUM(x) AS x, SUM(y) AS y, COUNT(*) AS n, SUM(x*t) AS xt, SUM(y*t) AS yt, SUM(t) AS t "
        "FROM newton, pts WHERE step < 25 AND t*(x*b1+y*b2+b3) < 1 GROUP BY step))",
        "predicted AS (SELECT origin, label, CASE WHEN x*b1+y*b2+b3 > 0 THEN 1 ELSE 0 END AS prediction FROM pts, newton WHERE step = 25)",
    ]


@query("linear_svm_split", recursive(sql(_quality_sql("predicted"), _MOID_LABELLED, *_newton_ctes())))
def linear_svm_split(spark, sf):
    rows = cascade.group_rows(_moid_labelled(spark, sf), ("atira", "aten"))
    return _report(kernel.split_by_clf(kernel.MarginSVC(kernel="linear"), ["a", "i"], rows)[0])


@query("rbf_svm_split")
def rbf_svm_split(spark, sf):
    est = kernel.MarginSVC(gamma=40.0, C=10.0)
    return _report(kernel.split_by_clf(est, ["w", "q", "e"], _moid_labelled(spark, sf))[0])


@query("split_by_clf")
def split_by_clf(spark, sf):
    df = _moid_labelled(spark, sf)
    gen, real = (df.filter(F.col("origin") == o) for o in ("gen", "real"))
    est = RandomForestClassifier(numTrees=20, maxDepth=8, seed=1)
    return kernel.split_by_clf(est, ["w", "q", "e"], gen, real)[0].select("oid", "label", "prediction")


@query("domain_mask")
def domain_mask(spark, sf):
    df = orbits(spark, sf).withColumn("in_domain", (F.col("q") <= 0.6 + F.col("w") / 1000).cast("int"))
    cols = ["w", "q"]
    mask = kernel.domain_mask(domains.estimator("1-mask"), df, cols, scaling.bounds(df, cols))
    out = mask.transform(df)
    return out.groupBy("in_domain", "prediction").agg(F.count("*").alias("n"))


def _centroid_ctes(p: str, rows: str, train: str, cols: list[str], label: str = "label") -> list[str]:
    """``{p}_p``: ``rows`` with the class of the nearest mean of ``train``, all scaled by common bounds."""
    at = lambda c: f"({c}-{p}_b.{c}_lo)/({p}_b.{c}_hi-{p}_b.{c}_lo)"
    away = lambda y: "+".join(f"POW({at('r.' + c).replace(p + '_b.r.', p + '_b.')}-m.{c}_{y}, 2)" for c in cols)
    return [
        f"{p}_b AS (SELECT " + ", ".join(f"MIN({c}) AS {c}_lo, MAX({c}) AS {c}_hi" for c in cols)
        + f" FROM (SELECT {', '.join(cols)} FROM {rows} UNION ALL SELECT {', '.join(cols)} FROM {train}))",
        f"{p}_m AS (SELECT " + ", ".join(f"AVG({at(c)}) FILTER ({label} = {y}) AS {c}_{y}" for c in cols for y in (0, 1)) + f" FROM {train}, {p}_b)",
        f"{p}_p AS (SELECT r.*, CASE WHEN {away(1)} < {away(0)} THEN 1 ELSE 0 END AS prediction FROM {rows} r, {p}_b, {p}_m m)",
    ]


_GEN_REAL = ["gen AS (SELECT * FROM lab WHERE origin = 'gen')", "obs AS (SELECT * FROM lab WHERE origin = 'real')"]


@query(
    "split_by_clf_rule",
    sql("SELECT oid, label, prediction FROM s_p", _MOID_LABELLED, *_GEN_REAL, *_centroid_ctes("s", "obs", "gen", ["w", "q", "e"])),
)
def split_by_clf_rule(spark, sf):
    """Split of the real orbits by nearest means of the virtual ones."""
    df = _moid_labelled(spark, sf)
    gen, real = (df.filter(F.col("origin") == o) for o in ("gen", "real"))
    return kernel.split_by_clf(CentroidClassifier(), ["w", "q", "e"], gen, real)[0].select("oid", "label", "prediction")


@query(
    "split_quality_rule",
    sql(_quality_sql("s_p"), _MOID_LABELLED, *_centroid_ctes("s", "lab", "lab", ["w", "q", "e"])),
)
def split_quality_rule(spark, sf):
    return _report(kernel.split_by_clf(CentroidClassifier(), ["w", "q", "e"], _moid_labelled(spark, sf))[0])


@query(
    "domain_mask_rule",
    sql(
        "SELECT CAST(in_domain AS INTEGER) AS in_domain, prediction, COUNT(*) AS n FROM k_p GROUP BY 1, 2",
        "flagged AS (SELECT *, CASE WHEN q <= 0.6e0 + w / 1000 THEN 1 ELSE 0 END AS in_domain FROM orbits)",
        *_centroid_ctes("k", "flagged", "flagged", ["w", "q"], "in_domain"),
    ),
)
def domain_mask_rule(spark, sf):
    df = orbits(spark, sf).withColumn("in_domain", (F.col("q") <= 0.6 + F.col("w") / 1000).cast("int"))
    cols = ["w", "q"]
    out = kernel.domain_mask(CentroidClassifier(), df, cols, scaling.bounds(df, cols)).transform(df)
    return out.groupBy("in_domain", "prediction").agg(F.count("*").alias("n"))


def _fold_ctes(k: int) -> list[str]:
    return [
        f"test{k} AS (SELECT * FROM lab WHERE oid % 3 = {k})", f"train{k} AS (SELECT * FROM lab WHERE oid % 3 <> {k})",
        # scaled by the training rows alone
        *[c.replace(f"SELECT w, q, e FROM test{k} UNION ALL ", "") for c in _centroid_ctes(f"f{k}", f"test{k}", f"train{k}", ["w", "q", "e"])],
    ]


@query(
    "kfold_rule",
    sql(
        "SELECT CAST(oid % 3 AS INTEGER) AS fold, " + r6(
            score="AVG(CASE WHEN prediction = label THEN 1e0 ELSE 0e0 END)", predicted_haz_fraction="AVG(prediction)", true_haz_fraction="AVG(label)",
        ) + " FROM (SELECT oid, label, prediction FROM f0_p UNION ALL SELECT oid, label, prediction FROM f1_p UNION ALL SELECT oid, label, prediction FROM f2_p) GROUP BY 1",
        _MOID_LABELLED, *_fold_ctes(0), *_fold_ctes(1), *_fold_ctes(2),
    ),
)
def kfold_rule(spark, sf):
    return rounded(crossval.kfold(CentroidClassifier(), ["w", "q", "e"], _moid_labelled(spark, sf), fold=F.col("oid") % 3))


@query(
    "fit_predict_rule",
    sql(
        "SELECT " + r6(
            score="AVG(CASE WHEN prediction = label THEN 1e0 ELSE 0e0 END)", predicted_haz_fraction="AVG(prediction)", true_haz_fraction="AVG(label)",
        ) + " FROM f_p",
        _MOID_LABELLED, *_GEN_REAL,
        # scaled by the training rows alone
        *[c.replace("SELECT w, q, e FROM obs UNION ALL ", "") for c in _centroid_ctes("f", "obs", "gen", ["w", "q", "e"])],
    ),
)
def fit_predict_rule(spark, sf):
    """Score of one fit on the virtual orbits, tested on the real ones."""
    df = _moid_labelled(spark, sf)
    gen, real = (df.filter(F.col("origin") == o) for o in ("gen", "real"))
    return rounded(crossval.fit_predict(CentroidClassifier(), ["w", "q", "e"], gen, real)[1])


@query(
    "positive_points_rule",
    sql(
        "SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, " + r6(x="w", y="q", z="e") + " FROM c_p WHERE prediction = 1",
        _MOID_LABELLED,
        "cube AS (SELECT ix, iy, iz, ix*1e0/29 AS w, iy*1e0/29 AS q, iz*1e0/29 AS e FROM (SELECT UNNEST(RANGE(30)) AS ix), (SELECT UNNEST(RANGE(30)) AS iy), (SELECT UNNEST(RANGE(30)) AS iz))",
        "lb AS (SELECT MIN(w) AS w0, MAX(w) AS w1, MIN(q) AS q0, MAX(q) AS q1, MIN(e) AS e0, MAX(e) AS e1 FROM lab)",
        "scaled AS (SELECT label, (w-w0)/(w1-w0) AS w, (q-q0)/(q1-q0) AS q, (e-e0)/(e1-e0) AS e FROM lab, lb)",
        *_centroid_ctes("c", "cube", "scaled", ["w", "q", "e"]),
    ),
)
def positive_points_rule(spark, sf):
    _, _, model = kernel.split_by_clf(CentroidClassifier(), ["w", "q", "e"], _moid_labelled(spark, sf))
    return rounded(grids.positive_points(spark, model.predict_unit, model.cols, 30))


def _stage_ctes(p: str, rows: str, cols: list[str], doubled: bool, where: str = "TRUE") -> list[str]:
    w = f"UNNEST({_DM_VALUES}) AS w" if doubled else "w"
    train = f"{p}_t AS (SELECT * FROM (SELECT label, {w}, a, e, i, om, q FROM {rows} WHERE origin = 'gen') WHERE {where})"
    return [train, *_centroid_ctes(p, rows, f"{p}_t", cols)]


@query(
    "cascade_rule",
    sql(
        "SELECT oid, grp, 's1' AS stage FROM s1_p WHERE prediction = 1 UNION ALL SELECT oid, grp, NULL FROM s1_p WHERE prediction = 0 "
        "UNION ALL SELECT oid, grp, 's2' FROM s2_p WHERE prediction = 1 UNION ALL SELECT oid, grp, 's3' FROM s3_p WHERE prediction = 1 "
        "UNION ALL SELECT oid, grp, NULL FROM s3_p WHERE prediction = 0 UNION ALL SELECT oid, grp, NULL FROM s4_p WHERE prediction = 0 "
        "UNION ALL SELECT oid, grp, CASE WHEN prediction = 1 THEN 's5' END FROM s5_p "
        "UNION ALL SELECT oid, NULL, NULL FROM lab WHERE oid NOT IN (SELECT oid FROM grp)",
        _MOID_LABELLED, "grp AS (" + TAGS.format(src="lab") + ")",
        "low AS (SELECT * FROM grp WHERE grp IN ('atira', 'aten'))", *_stage_ctes("s1", "low", ["a", "i"], False),
        "apollo AS (SELECT * FROM grp WHERE grp = 'apollo')", *_stage_ctes("s2", "apollo", ["w", "q", "i"], True, "q > 0.7"),
        "rest AS (SELECT * EXCLUDE (prediction) FROM s2_p WHERE prediction = 0)", *_stage_ctes("s3", "rest", ["w", "q", "a"], True),
        "amor AS (SELECT * FROM grp WHERE grp = 'amor')", *_stage_ctes("s4", "amor", ["w", "i"], True),
        "inside AS (SELECT * EXCLUDE (prediction) FROM s4_p WHERE prediction = 1)", *_stage_ctes("s5", "inside", ["w", "om", "q"], False),
    ),
)
def cascade_rule(spark, sf):
    """Stages of the first domain's shape with nearest means: which stage took which orbit."""
    double = lambda d: augment.double_mirror(d, "w", 180.0)
    stage = lambda name, cols, **more: cascade.Stage(name, cols, CentroidClassifier, **more)
    flows_ = [
        cascade.Flow(("atira", "aten"), [stage("s1", ["a", "i"])]),
        cascade.Flow(("apollo",), [
            stage("s2", ["w", "q", "i"], augment=[double], train_where=lambda: F.col("q") > 0.7),
            stage("s3", ["w", "q", "a"], augment=[double]),
        ]),
        cascade.Flow(("amor",), [stage("s4", ["w", "i"], augment=[double], follow="inside"), stage("s5", ["w", "om", "q"])]),
    ]
    return cascade.run_cascade(_moid_labelled(spark, sf), flows_)[0].select("oid", "grp", "stage")


def _cascade_query(k):
    @query(f"cascade_domain{k}")
    def run(spark, sf):
        return rounded(flows.mine_domain(_moid_labelled(spark, sf), k)[1])


for _k in (1, 2, 3):
    _cascade_query(_k)


@query(
    "domain4_summary",
    sql(
        "SELECT origin, CAST(4 AS INTEGER) AS domain, CAST(SUM(label) AS BIGINT) AS extracted_pha, CAST(SUM(1-label) AS BIGINT) AS trapped_nha, "
        + r6(pha_fraction="SUM(label)*1e0/SUM(label)", nha_fraction="SUM(1-label)*1e0/SUM(1-label)", purity="AVG(label)")
        + " FROM lab GROUP BY origin",
        LABELLED,
    ),
)
def domain4_summary(spark, sf):
    """Domain 4 has no classifier: all of it is the region."""
    df = labelled_orbits(spark, sf).withColumns(
        {"domain": F.lit(4), "grp": F.lit(None).cast("string"), "first_tag": F.lit(True), "extracted": F.lit(True)}
    )
    out = quality.summary(df).filter(F.col("level") == 1)
    return rounded(out.drop("grp", "level"))


@query("kfold")
def kfold(spark, sf):
    est = kernel.MarginSVC(gamma=20.0, C=5.0, numFeatures=256)
    return rounded(crossval.kfold(est, ["w", "q", "e"], _moid_labelled(spark, sf)))


# --- density clusters ------------------------------------------------------------------------


def dbscan_ctes(p: str, src: str, x: str, y: str, eps: str, m: int) -> list[str]:
    """Clusters of the rows in ``src`` by neighbour pairs and label spreading, as ``{p}_lab``."""
    return [
        f"{p}_b AS (SELECT MIN({x}) AS x0, MAX({x}) AS x1, MIN({y}) AS y0, MAX({y}) AS y1 FROM {src})",
        f"{p}_u AS MATERIALIZED (SELECT oid, ({x}-x0)/(x1-x0) AS u, ({y}-y0)/(y1-y0) AS v, "
        f"FLOOR(({x}-x0)/(x1-x0)/{eps}) AS cx, FLOOR(({y}-y0)/(y1-y0)/{eps}) AS cy FROM {src}, {p}_b)",
        f"{p}_e AS MATERIALIZED (SELECT s.oid AS l, t.oid AS r FROM (SELECT oid, u, v, cx+dx AS jx, cy+dy AS jy FROM {p}_u, "
        f"(SELECT UNNEST(RANGE(-1, 2)) AS dx), (SELECT UNNEST(RANGE(-1, 2)) AS dy)) s JOIN {p}_u t ON s.jx = t.cx AND s.jy = t.cy "
        f"WHERE (s.u-t.u)*(s.u-t.u)+(s.v-t.v)*(s.v-t.v) <= {eps}*{eps})",
        f"{p}_core AS MATERIALIZED (SELECT l AS oid FROM {p}_e GROUP BY l HAVING COUNT(*) >= {m})",
        f"{p}_ce AS MATERIALIZED (SELECT l, r FROM {p}_e WHERE l IN (SELECT oid FROM {p}_core) AND r IN (SELECT oid FROM {p}_core))",
        f"{p}_cc(oid, lab) USING KEY (oid) AS (SELECT oid, oid FROM {p}_core UNION "
        f"SELECT e.l, MIN(w.lab) FROM {p}_cc w JOIN {p}_ce e ON e.r = w.oid JOIN recurring.{p}_cc k ON k.oid = e.l "
        f"WHERE w.lab < k.lab GROUP BY e.l)",
        f"{p}_id AS (SELECT oid, DENSE_RANK() OVER (ORDER BY lab) - 1 AS cluster_id FROM {p}_cc)",
        f"{p}_bd AS (SELECT e.l AS oid, MIN(i.cluster_id) AS cluster_id FROM {p}_e e JOIN {p}_id i ON i.oid = e.r GROUP BY e.l)",
        f"{p}_lab AS (SELECT u.oid, CAST(COALESCE(i.cluster_id, d.cluster_id, -1) AS INTEGER) AS cluster_id, i.oid IS NOT NULL AS is_core "
        f"FROM {p}_u u LEFT JOIN {p}_id i USING (oid) LEFT JOIN {p}_bd d USING (oid))",
    ]


@query(
    "dbscan",
    recursive(
        sql(
            "SELECT oid, cluster_id, CAST(is_core AS INTEGER) AS is_core FROM d_lab",
            *dbscan_ctes("d", "orbits", "a", "i", "0.015e0", 100),
        )
    ),
)
def dbscan_query(spark, sf):
    out = db.dbscan(orbits(spark, sf).select("oid", "a", "i"), ["a", "i"])
    return out.select("oid", "cluster_id", F.col("is_core").cast("int").alias("is_core"))


_EMBEDDED = (
    "emb AS (SELECT vec_id AS oid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
)


def _embedded(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    xy = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xy")]
    return vectors.select(F.col("vec_id").alias("oid"), *xy)


@query(
    "dbscan_embeddings",
    recursive(
        sql(
            "SELECT oid, cluster_id, CAST(is_core AS INTEGER) AS is_core FROM d_lab",
            _EMBEDDED,
            *dbscan_ctes("d", "emb", "x", "y", "0.05e0", 5),
        )
    ),
)
def dbscan_embeddings(spark, sf):
    out = db.dbscan(_embedded(spark, sf), ["x", "y"], 0.05, 5)
    return out.select("oid", "cluster_id", F.col("is_core").cast("int").alias("is_core"))


@query(
    "layered_dbscan",
    recursive(
        sql(
            "SELECT oid, CAST(cluster_id + 1 AS INTEGER) AS cluster_id, CAST(0 AS INTEGER) AS layer FROM d_lab WHERE cluster_id >= 0 UNION ALL "
            "SELECT oid, CAST(CASE WHEN cluster_id < 0 THEN n1 + n2 + 1 ELSE n1 + cluster_id + 1 END AS INTEGER), "
            "CAST(CASE WHEN cluster_id < 0 THEN 2 ELSE 1 END AS INTEGER) FROM e_lab, "
            "(SELECT MAX(cluster_id) + 1 AS n1 FROM d_lab), (SELECT MAX(cluster_id) + 1 AS n2 FROM e_lab)",
            *dbscan_ctes("d", "orbits", "a", "i", "0.015e0", 100),
            "left_over AS (SELECT o.* FROM orbits o JOIN d_lab USING (oid) WHERE cluster_id < 0)",
            *dbscan_ctes("e", "left_over", "a", "i", "0.03e0", 60),
        )
    ),
)
def layered_dbscan(spark, sf):
    df = orbits(spark, sf).select("oid", "a", "i")
    out = clusters.layered_dbscan(df, ["a", "i"], [(0.015, 100), (0.03, 60)])
    return out.select("oid", "cluster_id", "layer")


@query(
    "merge_clusters",
    sql(
        f"SELECT oid, cluster_id, CAST(CASE WHEN cluster_id IN (3, 1) THEN 1 ELSE 2 END AS INTEGER) AS merged_id FROM (SELECT oid, {_cluster_sql()} AS cluster_id FROM orbits)"
    ),
)
def merge_clusters(spark, sf):
    df = rule_clusters(orbits(spark, sf)).select("oid", "cluster_id")
    return clusters.merge_clusters(df, [[3, 1]])


@query(
    "merge_clusters_keep_rest",
    sql(
        f"SELECT oid, cluster_id, CAST(CASE cluster_id WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 END AS INTEGER) AS merged_id FROM (SELECT oid, {_cluster_sql()} AS cluster_id FROM orbits) WHERE cluster_id <> 2 "
        f"UNION ALL SELECT oid, 2, CAST(UNNEST([1, 2]) AS INTEGER) FROM orbits WHERE {_cluster_sql()} = 2"
    ),
)
def merge_clusters_keep_rest(spark, sf):
    df = rule_clusters(orbits(spark, sf)).select("oid", "cluster_id")
    return clusters.merge_clusters(df, [[3, 2], [1, 2]], merge_rest=False)


@query(
    "fuse_clusters",
    sql(f"SELECT oid, cluster_id, CASE WHEN cluster_id >= 0 THEN 7 END AS class_id FROM (SELECT oid, CASE WHEN q > 0.9 THEN -1 ELSE {_cluster_sql()} END AS cluster_id FROM orbits)"),
)
def fuse_clusters(spark, sf):
    """All clustered rows as one class; noise stays outside."""
    df = rule_clusters(orbits(spark, sf))
    noise = df.withColumn("cluster_id", F.when(F.col("q") > 0.9, -1).otherwise(F.col("cluster_id")))
    return clusters.fuse_clusters(noise.select("oid", "cluster_id"), 7)


@query("classify_by_cluster")
def classify_by_cluster(spark, sf):
    df = _moid_labelled(spark, sf).select("oid", "label", "a", "i")
    layered = clusters.layered_dbscan(df, ["a", "i"], [(0.015, 100), (0.03, 60)])
    est = RandomForestClassifier(numTrees=20, maxDepth=10, seed=1)
    return rounded(clusters.classify_by_cluster(layered, est, ["a", "i"], df)[1])


_KNN = 15
_KNN_CTES = [
    f"asked AS (SELECT oid, {LABEL_MOID} AS label, a, i FROM orbits WHERE origin = 'real')",
    "gen AS (SELECT oid, a, i FROM orbits WHERE origin = 'gen')",
    *dbscan_ctes("d", "gen", "a", "i", "0.015e0", 100),
    "kb AS (SELECT MIN(a) AS a0, MAX(a) AS a1, MIN(i) AS i0, MAX(i) AS i1 FROM orbits)",
    "taught AS (SELECT (a-a0)/(a1-a0) AS u, (i-i0)/(i1-i0) AS v, cluster_id FROM gen JOIN d_lab USING (oid), kb WHERE cluster_id >= 0)",
    "placed AS (SELECT oid, label, (a-a0)/(a1-a0) AS u, (i-i0)/(i1-i0) AS v FROM asked, kb)",
    "near AS (SELECT p.oid, p.label, MIN({'d': (p.u-t.u)*(p.u-t.u)+(p.v-t.v)*(p.v-t.v), 'c': t.cluster_id}, " + str(_KNN) + ") AS l FROM placed p, taught t GROUP BY p.oid, p.label)",
    "votes AS (SELECT oid, label, c, COUNT(*) AS n FROM (SELECT oid, label, UNNEST(l).c AS c FROM near) GROUP BY ALL)",
    "first AS (SELECT oid, c AS cluster_id FROM votes QUALIFY ROW_NUMBER() OVER (PARTITION BY oid ORDER BY n DESC, c) = 1)",
    "won AS (SELECT oid, label, cluster_id FROM asked LEFT JOIN first USING (oid))",
]


def _knn(spark, sf):
    """Real orbits by the density clusters of the virtual ones."""
    df = _moid_labelled(spark, sf).select("oid", "origin", "label", "a", "i")
    found = db.dbscan(df.filter(F.col("origin") == "gen").select("oid", "a", "i"), ["a", "i"])
    return clusters.classify_by_knn(found, ["a", "i"], df.filter(F.col("origin") == "real"), _KNN)


@query("classify_by_knn", recursive(sql("SELECT oid, cluster_id FROM won", *_KNN_CTES)))
def classify_by_knn(spark, sf):
    return _knn(spark, sf)[0].select("oid", "cluster_id")


@query(
    "knn_haz_fraction",
    recursive(sql(f"SELECT cluster_id, CAST(COUNT(*) AS BIGINT) AS n, {r6(haz_fraction='AVG(label)')} FROM won GROUP BY cluster_id", *_KNN_CTES)),
)
def knn_haz_fraction(spark, sf):
    return rounded(_knn(spark, sf)[1])


# --- meshes ----------------------------------------------------------------------------------

_KDE = 51


@query(
    "kde_grid",
    sql(
        f"SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r6(x=f'MIN(x0)+ix*1e0/{_KDE-1}*(MIN(x1)-MIN(x0))', y=f'MIN(y0)+iy*1e0/{_KDE-1}*(MIN(y1)-MIN(y0))', log_density='LN(SUM(EXP(-(POW(u-ix*1e0/50,2)+POW(v-iy*1e0/50,2))/(2*0.05e0*0.05e0)))/(COUNT(*)*2*PI()*0.05e0*0.05e0))')} "
        f"FROM n, (SELECT UNNEST(RANGE(0, {_KDE})) AS ix), (SELECT UNNEST(RANGE(0, {_KDE})) AS iy) GROUP BY ix, iy",
        "b2 AS (SELECT MIN(w) AS x0, MAX(w) AS x1, MIN(q) AS y0, MAX(q) AS y1 FROM orbits)",
        "n AS (SELECT (w-x0)/(x1-x0) AS u, (q-y0)/(y1-y0) AS v, x0, x1, y0, y1 FROM orbits, b2)",
    ),
)
def kde_grid(spark, sf):
    scaled, scales = scaling.minmax_normalize(orbits(spark, sf).select("w", "q"), ["w", "q"])
    return rounded(density.kde_grid(scaled, ["w", "q"], 0.05, _KDE, scales=scales)[0])


@query(
    "kde_grid_narrow",
    sql(
        f"SELECT CAST(g.ix AS INTEGER) AS ix, CAST(g.iy AS INTEGER) AS iy, {r6(x=f'MIN(x0)+g.ix*1e0/{_KDE-1}*(MIN(x1)-MIN(x0))', y=f'MIN(y0)+g.iy*1e0/{_KDE-1}*(MIN(y1)-MIN(y0))', log_density='MIN(least)*-1e0/(2*0.01e0*0.01e0)+LN(SUM(EXP(-(POW(u-g.ix*1e0/50,2)+POW(v-g.iy*1e0/50,2)-least)/(2*0.01e0*0.01e0))))-LN(COUNT(*))-LN(2*PI()*0.01e0*0.01e0)')} "
        "FROM n, g GROUP BY g.ix, g.iy",
        "b2 AS (SELECT MIN(w) AS x0, MAX(w) AS x1, MIN(q) AS y0, MAX(q) AS y1 FROM orbits)",
        "n AS MATERIALIZED (SELECT (w-x0)/(x1-x0) AS u, (q-y0)/(y1-y0) AS v, x0, x1, y0, y1 FROM orbits, b2 WHERE q > 0.4 + 0.001 * w)",
        f"g AS MATERIALIZED (SELECT ix, iy, MIN(POW(u-ix*1e0/50,2)+POW(v-iy*1e0/50,2)) AS least FROM n, (SELECT UNNEST(RANGE(0, {_KDE})) AS ix), (SELECT UNNEST(RANGE(0, {_KDE})) AS iy) GROUP BY ix, iy)",
    ),
)
def kde_grid_narrow(spark, sf):
    """A bandwidth at which most of the mesh lies hundreds of bandwidths away from any orbit."""
    scaled, scales = scaling.minmax_normalize(orbits(spark, sf).select("w", "q", (F.col("q") > 0.4 + 0.001 * F.col("w")).alias("high")), ["w", "q"])
    return rounded(density.kde_grid(scaled.filter("high"), ["w", "q"], 0.01, _KDE, scales=scales)[0])


@query(
    "kde_grid_embeddings",
    sql(
        f"SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r6(x='ix*1e0/40', y='iy*1e0/40', log_density='LN(SUM(EXP(-(POW(u-ix*1e0/40,2)+POW(v-iy*1e0/40,2))/(2*0.1e0*0.1e0)))/(COUNT(*)*2*PI()*0.1e0*0.1e0))')} "
        "FROM n, (SELECT UNNEST(RANGE(0, 41)) AS ix), (SELECT UNNEST(RANGE(0, 41)) AS iy) GROUP BY ix, iy",
        _EMBEDDED,
        "b2 AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM emb)",
        "n AS (SELECT (x-x0)/(x1-x0) AS u, (y-y0)/(y1-y0) AS v FROM emb, b2)",
    ),
)
def kde_grid_embeddings(spark, sf):
    scaled, _ = scaling.minmax_normalize(_embedded(spark, sf), ["x", "y"])
    return rounded(density.kde_grid(scaled, ["x", "y"], 0.1, 41)[0])


def _rule(df, *cols):
    """Rule in normalised units in place of a trained model."""
    total = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    return df.withColumn("prediction", F.when(total < 0.6, 1).otherwise(0))


_MESH = 60
_WQI_BOUNDS = _bounds_cte("b2", "orbits", "w", "q", "i")


def _axis(index, col, num, n=None):
    t = f"{index}*1e0/{num - 1}"
    return f"{t}*(b2.{col}_max-b2.{col}_min)+b2.{col}_min"


@query(
    "decision_grid",
    sql(
        f"SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r6(x=_axis('ix', 'w', 100), y=_axis('iy', 'q', 100))}, "
        "CAST(CASE WHEN POW(0.25e0/1.5e0+ix*(1e0-0.5e0/1.5e0)/99, 2)+POW(iy*1e0/99, 2) < 0.6e0 THEN 1 ELSE 0 END AS INTEGER) AS prediction "
        "FROM b2, (SELECT UNNEST(RANGE(0, 100)) AS ix), (SELECT UNNEST(RANGE(0, 100)) AS iy)",
        _WQI_BOUNDS,
    ),
)
def decision_grid(spark, sf):
    scales = scaling.bounds(orbits(spark, sf), ["w", "q"])
    out = grids.decision_grid(
        spark, lambda d: _rule(d, "w", "q"), ["w", "q"], 100, scales, extend=(0.25, 0.0)
    )
    return rounded(out)


@query("decision_grid_svm")
def decision_grid_svm(spark, sf):
    df = _moid_labelled(spark, sf)
    _, _, model = kernel.split_by_clf(kernel.MarginSVC(gamma=30.0, C=10.0, numFeatures=512), ["q", "e"], df)
    return rounded(grids.decision_grid(spark, model.predict_unit, model.cols, 100, model.scales))


_SURFACE = (
    f"cube AS (SELECT ix, iy, iz, CASE WHEN POW(ix*1e0/{_MESH-1},2)+POW(iy*1e0/{_MESH-1},2)+POW(iz*1e0/{_MESH-1},2) < 0.6e0 THEN 1 ELSE 0 END AS pr "
    f"FROM (SELECT UNNEST(RANGE(0, {_MESH})) AS ix), (SELECT UNNEST(RANGE(0, {_MESH})) AS iy), (SELECT UNNEST(RANGE(0, {_MESH})) AS iz))"
)


def _surface_sql(masked: bool) -> str:
    off = f"POW(ix*1e0/{_MESH-1},2)+POW(iy*1e0/{_MESH-1},2) >= 0.6e0"
    z = f"CASE WHEN {off} THEN MAX(CASE WHEN {off} THEN b2.i_min ELSE zz END) OVER () + 1 ELSE zz END" if masked else "zz"
    return sql(
        f"SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r6(x=_axis('ix', 'w', _MESH), y=_axis('iy', 'q', _MESH), z=z)} "
        f"FROM b2, (SELECT ix, iy, COALESCE(MAX(CASE WHEN pr = 1 THEN iz*1e0/{_MESH-1} END), 0e0)*(MIN(i_max)-MIN(i_min))+MIN(i_min) AS zz FROM cube, b2 GROUP BY ix, iy)",
        _WQI_BOUNDS,
        _SURFACE,
    )


@query("decision_surface", _surface_sql(False))
def decision_surface(spark, sf):
    cols = ["w", "q", "i"]
    scales = scaling.bounds(orbits(spark, sf), cols)
    return rounded(grids.decision_surface(spark, lambda d: _rule(d, *cols), cols, _MESH, scales))


@query("decision_surface_masked", _surface_sql(True))
def decision_surface_masked(spark, sf):
    cols = ["w", "q", "i"]
    scales = scaling.bounds(orbits(spark, sf), cols)
    mask = (lambda d: _rule(d, "w", "q"), 0)
    return rounded(
        grids.decision_surface(spark, lambda d: _rule(d, *cols), cols, _MESH, scales, masks=[mask])
    )


_MASK_OFF = (
    f"POW(ix*1e0/{_MESH-1}-m.w_1,2)+POW(iy*1e0/{_MESH-1}-m.q_1,2) >= POW(ix*1e0/{_MESH-1}-m.w_0,2)+POW(iy*1e0/{_MESH-1}-m.q_0,2)"
)


@query(
    "decision_surface_trained_mask",
    sql(
        f"SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r6(x=_axis('ix', 'w', _MESH), y=_axis('iy', 'q', _MESH), z=f'CASE WHEN {_MASK_OFF} THEN MIN(CASE WHEN {_MASK_OFF} THEN b2.i_min ELSE zz END) OVER () - 1 ELSE zz END')} "
        f"FROM b2, k_m m, (SELECT ix, iy, COALESCE(MAX(CASE WHEN pr = 1 THEN iz*1e0/{_MESH-1} END), 0e0)*(MIN(i_max)-MIN(i_min))+MIN(i_min) AS zz FROM cube, b2 GROUP BY ix, iy)",
        _WQI_BOUNDS, _SURFACE,
        "flagged AS (SELECT *, CASE WHEN q <= 0.6e0 + w / 1000 THEN 1 ELSE 0 END AS in_domain FROM orbits)",
        *_centroid_ctes("k", "flagged", "flagged", ["w", "q"], "in_domain"),
    ),
)
def decision_surface_trained_mask(spark, sf):
    """A surface outside whose domain, learnt from the orbits in it and the others, nothing is drawn."""
    cols = ["w", "q", "i"]
    df = orbits(spark, sf).withColumn("in_domain", (F.col("q") <= 0.6 + F.col("w") / 1000).cast("int"))
    scales = scaling.bounds(df, cols)
    mask = kernel.domain_mask(CentroidClassifier(), df, ["w", "q"], {c: scales[c] for c in ("w", "q")})
    return rounded(
        grids.decision_surface(spark, lambda d: _rule(d, *cols), cols, _MESH, scales, masks=[(mask.predict_unit, 0)], mask_level="below")
    )


@query("positive_points")
def positive_points(spark, sf):
    df = _moid_labelled(spark, sf)
    est = kernel.MarginSVC(gamma=40.0, C=10.0, numFeatures=512)
    _, _, model = kernel.split_by_clf(est, ["w", "q", "e"], df)
    return rounded(grids.positive_points(spark, model.predict_unit, model.cols, 40))


@query(
    "cluster_points",
    sql(f"SELECT {_cluster_sql()} AS cluster_id, {r6(w='w', q='q')} FROM orbits"),
)
def cluster_points(spark, sf):
    scaled, scales = scaling.minmax_normalize(rule_clusters(orbits(spark, sf)), ["w", "q"], None)
    return rounded(grids.cluster_points(scaled, scales))
