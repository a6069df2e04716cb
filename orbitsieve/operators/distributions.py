"""Fits of one-dimensional densities to histograms, and sampling from them.

A histogram is one aggregate over the catalog; what follows works on its few bins and on tables of
fixed size. A draw is the value below which a uniform share of the fitted density lies, cut to the range of the
data, so nothing is rejected or redrawn. The share below comes from a table of knots that is split wherever the
curve between two knots isn't known to TOLERANCE, tails included; a family with a formula for it is polished to
the last digits.
"""

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.pdfs import FAMILIES, Family, Moments
from ..functions.uniforms import with_uniforms
from ..scratch import written
from . import density
from .fitting import fit_bins
from .histogram import hist_table
from .scaling import bounds

FIRST_KNOTS = 65
TOLERANCE = 1e-8  # error of a draw between knots, as a share of the range
RARE = 1e-7  # share of the draws below which a piece isn't split further
SPLIT, DEPTH = 4, 10
MOST_CELLS = 1 << 17  # of a kernel density's sketch

# Families fitted to the orbital parameters.
DEFAULT_FAMILIES = {
    "a": "johnsonsb", "i": "exponweib", "w": "harmonic", "om": "harmonic", "q": "pearson3",
}


@dataclass(frozen=True)
class Fitted:
    """A fitted density on [lo, hi]. ``knots``: places, shares below them and densities there.

    ``status`` tells how the fit ended (``given`` if the parameters weren't fitted).
    """

    name: str
    family: Family
    params: dict[str, float]
    sse: float
    lo: float
    hi: float
    status: str = "given"
    knots: tuple[tuple[float, ...], ...] = ()
    whole: tuple[float, float] = (0.0, 1.0)  # the formula's values at lo and hi

    @property
    def family_name(self) -> str:
        return next((k for k, f in FAMILIES.items() if f is self.family), "custom")


def _family(f: str | Family) -> Family:
    return FAMILIES[f] if isinstance(f, str) else f


def _harmonic_fit(hist: DataFrame, names: list[str]) -> dict[str, tuple]:
    """y = A sin 2x + B cos 2x + C is linear: sums over the bins and a 3 x 3 system."""
    s, c, y = F.sin(2 * F.radians("center")), F.cos(2 * F.radians("center")), F.col("density")
    sums = hist.filter(F.col("name").isin(names)).groupBy("name").agg(
        *[F.sum(v).alias(k) for k, v in {
            "ss": s * s, "sc": s * c, "cc": c * c, "s": s, "c": c, "n": F.lit(1.0),
            "sy": s * y, "cy": c * y, "y": y, "yy": y * y,
        }.items()]
    )
    out = {}
    for r in sums.collect():
        m = np.array([[r["ss"], r["sc"], r["s"]], [r["sc"], r["cc"], r["c"]], [r["s"], r["c"], r["n"]]])
        rhs = np.array([r["sy"], r["cy"], r["y"]])
        co = np.linalg.lstsq(m, rhs, rcond=None)[0]
        params = {"amp": math.hypot(co[0], co[1]), "phase": math.atan2(co[1], co[0]), "shift": float(co[2])}
        out[r["name"]] = (params, max(0.0, float(r["yy"] - co @ rhs)))
    return out


def fit_distributions(
    df: DataFrame, families: dict[str, str | Family] = DEFAULT_FAMILIES, n: int = 50
) -> dict[str, Fitted]:
    """Fit a density to each column (a family's name, or any ``Family``) and prepare it for sampling."""
    spark, names = df.sparkSession, list(families)
    kinds = {c: _family(f) for c, f in families.items()}
    lim = bounds(df, names)
    hist = written(hist_table(df, names, n).select("name", "center", "width", "density").coalesce(1), "bins").persist()
    weight = F.col("density") * F.col("width")
    sums = hist.groupBy("name").agg(
        F.sum(weight * F.col("center")).alias("m"), F.sum(weight * F.col("center") * F.col("center")).alias("m2")
    )
    moments = {r["name"]: Moments(*lim[r["name"]], r["m"], math.sqrt(max(r["m2"] - r["m"] ** 2, 1e-12))) for r in sums.collect()}
    waves = [c for c, f in kinds.items() if f is FAMILIES["harmonic"]]
    flat = [c for c, f in kinds.items() if f is FAMILIES["uniform"]]
    jobs = {c: (f, f.starts(moments[c]), moments[c].span) for c, f in kinds.items() if c not in (*waves, *flat)}
    solved = fit_bins(hist, jobs) if jobs else {}
    solved |= {c: (*fit, "closed form") for c, fit in _harmonic_fit(hist, waves).items()} if waves else {}
    solved |= {c: ({"lo": lim[c][0], "hi": lim[c][1]}, 0.0, "closed form") for c in flat}
    hist.unpersist()
    raw = [Fitted(c, f, solved[c][0], float(solved[c][1]), *lim[c], solved[c][2]) for c, f in kinds.items()]
    return {d.name: d for d in tabulated(spark, raw)}


def given(spark: SparkSession, name: str, family: str | Family, params: dict[str, float], lo: float, hi: float) -> Fitted:
    """A density with known parameters, cut to [lo, hi]."""
    return tabulated(spark, [Fitted(name, _family(family), params, 0.0, lo, hi)])[0]


def uniform_distributions(limits: dict[str, tuple[float, float]]) -> dict[str, Fitted]:
    """Flat densities on given bounds."""
    flat = FAMILIES["uniform"]
    return {
        c: Fitted(c, flat, {"lo": lo, "hi": hi}, 0.0, lo, hi, knots=((lo, hi), (0.0, 1.0), (1 / (hi - lo),) * 2))
        for c, (lo, hi) in limits.items()
    }


def pdf_column(d: Fitted, x: Column) -> Column:
    return d.family.pdf(x, *[F.lit(float(v)) for v in d.family.args(d.params)])


def cdf_column(d: Fitted, x: Column) -> Column:
    """The share below x by the family's formula, cut to the range."""
    raw = d.family.cdf(x, *[F.lit(float(v)) for v in d.family.args(d.params)])
    return (raw - d.whole[0]) / (d.whole[1] - d.whole[0])


# Nodes and weights of the integral over a piece.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(8)


def _slopes(x, share, dens):
    """Slopes of the place as a function of the share at both ends of each piece, kept monotone."""
    secant = np.diff(x) / np.maximum(np.diff(share), 1e-300)
    with np.errstate(divide="ignore"):
        slope = 1 / np.maximum(dens, 1e-300)
    return secant, np.minimum(slope[:-1], 3 * secant), np.minimum(slope[1:], 3 * secant)


def _between(x, share, dens, at, u):
    """Place of the shares ``u`` in the pieces ``at``: a monotone cubic."""
    secant, left, right = _slopes(x, share, dens)
    h = np.maximum(share[at + 1] - share[at], 1e-300)
    t = (u - share[at]) / h
    return x[at] + h * t * (
        left[at] * (1 - t) ** 2 + t * (3 - 2 * t) * secant[at] - right[at] * t * (1 - t)
    )


def _knots(edges: list[np.ndarray], evaluate) -> list[tuple]:
    """Knots for several densities at once; ``evaluate`` gives the densities at lists of places.

    A piece is split while the cubic misses its middle and draws fall into it at all.
    """
    edges = [np.asarray(e, float) for e in edges]
    out: list[tuple | None] = [None] * len(edges)
    for depth in range(DEPTH + 1):
        todo = [k for k, o in enumerate(out) if o is None]
        if not todo:
            break
        places = []
        for k in todo:
            e = edges[k]
            halves = np.sort(np.concatenate([e, (e[:-1] + e[1:]) / 2]))
            mid, half = (halves[:-1] + halves[1:]) / 2, np.diff(halves) / 2
            places.append(np.concatenate([e, (mid[:, None] + half[:, None] * _NODES).ravel()]))
        for k, values in zip(todo, evaluate(todo, places)):
            e = edges[k]
            values = np.where(np.isfinite(values), np.maximum(values, 0.0), 0.0)  # a pole is no node of the integral
            dens, inner = values[: len(e)], values[len(e) :].reshape(-1, len(_NODES))
            mass = inner @ _WEIGHTS * np.repeat(np.diff(e) / 4, 2)
            if mass.sum() <= 0:
                mass, dens = np.repeat(np.diff(e) / 2, 2), np.ones(len(e))
            share = np.concatenate([[0.0], np.cumsum(mass)])
            dens, share = dens / share[-1], share / share[-1]
            knots, middle = share[::2], share[1::2]
            guess = _between(e, knots, dens, np.arange(len(e) - 1), middle)
            off = np.abs(guess - (e[:-1] + e[1:]) / 2) > TOLERANCE * (e[-1] - e[0])
            split = off & (np.diff(knots) > RARE)
            if depth == DEPTH or not split.any():
                out[k] = (tuple(e.tolist()), tuple(knots.tolist()), tuple(dens.tolist()))
            else:
                cuts = [np.linspace(a, b, SPLIT + 1)[1:-1] for a, b in zip(e[:-1][split], e[1:][split])]
                edges[k] = np.sort(np.concatenate([e, *cuts]))
    return out


def tabulated(spark: SparkSession, dists: list[Fitted]) -> list[Fitted]:
    """Add knots to fitted densities; one job evaluates all densities of a round."""

    def evaluate(todo, places):
        table = pd.DataFrame({"d": np.repeat(todo, [len(p) for p in places]), "x": np.concatenate(places)})
        value = F.lit(None).cast("double")
        for k in todo:
            value = F.when(F.col("d") == k, pdf_column(dists[k], F.col("x"))).otherwise(value)
        rows = spark.createDataFrame(table).withColumn("at", F.monotonically_increasing_id())
        got = rows.select("at", value.alias("f")).toPandas().sort_values("at")["f"].to_numpy(dtype=float)
        return np.split(got, np.cumsum([len(p) for p in places])[:-1])

    tables = _knots([np.linspace(d.lo, d.hi, FIRST_KNOTS) for d in dists], evaluate)
    with_cdf = [d for d in dists if d.family.cdf]
    ends = {}
    if with_cdf:
        raw = lambda d, x: d.family.cdf(F.lit(float(x)), *[F.lit(float(v)) for v in d.family.args(d.params)])
        row = spark.range(1).select(*[raw(d, x).alias(f"{k}_{e}") for k, d in enumerate(with_cdf) for e, x in enumerate((d.lo, d.hi))]).first()
        ends = {id(d): (float(row[2 * k]), float(row[2 * k + 1])) for k, d in enumerate(with_cdf)}
    return [replace(d, knots=t, whole=ends.get(id(d), (0.0, 1.0))) for d, t in zip(dists, tables)]


def kde_distribution(df: DataFrame, col: str, bandwidth: float | None = None) -> Fitted:
    """Gaussian kernel density of a column, on its range widened by nine bandwidths.

    Rows are sketched as count, mean and variance per cell of a sixteenth of the bandwidth, one aggregate; the kernel
    is laid over the cells with their variance. A range of more than MOST_CELLS cells is refused.
    """
    width = bandwidth or density.scott_bandwidth(df, col)
    lo, hi = bounds(df, [col])[col]
    if (hi - lo) * 16 > MOST_CELLS * width:
        raise ValueError(f"bandwidth {width} is too narrow for values of {col} from {lo} to {hi}")
    x = F.col(col) - lo
    cells = df.select(x.alias("x")).dropna().groupBy(F.floor(F.col("x") / (width / 16)).alias("k")).agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    ).toPandas().sort_values("m")
    n, m, v = (cells[c].to_numpy(dtype=float) for c in ("n", "m", "v"))
    m, spread = m + lo, v / (2 * width * width)

    def evaluate(_, places):
        out = np.zeros(len(places[0]))
        first, last = np.searchsorted(m, places[0] - 9 * width), np.searchsorted(m, places[0] + 9 * width)
        for step in range(int((last - first).max(initial=0))):
            at = np.minimum(first + step, len(m) - 1)
            z2 = ((places[0] - m[at]) / width) ** 2
            out += np.where(first + step < last, n[at] * np.exp(-z2 / 2) * (1 + spread[at] * (z2 - 1)), 0.0)
        return [out]

    d = Fitted(col, Family(("bandwidth",), None, lambda _: []), {"bandwidth": width}, 0.0, lo - 9 * width, hi + 9 * width)
    pieces = max(FIRST_KNOTS, math.ceil(2 * (d.hi - d.lo) / width))
    return replace(d, knots=_knots([np.linspace(d.lo, d.hi, pieces)], evaluate)[0])


def cut_density(d: Fitted, factor) -> Fitted:
    """The density times ``factor`` (of numpy places), on the same range."""
    x, _, dens = (np.array(v) for v in d.knots)
    at = lambda places: np.interp(places, x, dens) * factor(places)
    if sum(at(x)) + sum(at((x[:-1] + x[1:]) / 2)) <= 0:
        raise ValueError(f"nothing of {d.name} is left")
    none = Family(d.family.params, None, d.family.starts)
    return replace(d, family=none, knots=_knots([x], lambda _, places: [at(places[0])])[0])


def below(d: Fitted, places: np.ndarray) -> np.ndarray:
    """Share of the draws below each of the places (numpy)."""
    x, share, dens = (np.array(v) for v in d.knots)
    at = np.clip(np.searchsorted(x, places, side="right") - 1, 0, len(x) - 2)
    h = x[at + 1] - x[at]
    t = np.clip((places - x[at]) / h, 0.0, 1.0)
    rise = share[at + 1] - share[at]
    left, right = np.minimum(dens[at] * h, 3 * rise), np.minimum(dens[at + 1] * h, 3 * rise)
    return share[at] + t * (left * (1 - t) ** 2 + t * (3 - 2 * t) * rise - right * t * (1 - t))


def _array(values) -> Column:
    # one literal that is folded into an array, not a literal a value
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _position(values: Column, size: int, x: Column) -> Column:
    """Place (from 0) of the last of ``size`` rising values that isn't above x, the last but one at most."""
    steps = [1 << b for b in reversed(range(max(size - 1, 1).bit_length()))]
    fits = lambda k, s: (k + s <= size - 2) & (F.get(values, k + s) <= x)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, s: F.when(fits(k, s), k + s).otherwise(k))


def _cubic(keys: Column, to: Column, left: Column, right: Column, size: int, x: Column) -> Column:
    """Monotone cubic through (keys, to) with the given end slopes of each piece, at x."""

    def piece(k: Column, v: Column) -> Column:
        h = F.get(keys, k + 1) - F.get(keys, k)
        t = F.when(h > 0, (v - F.get(keys, k)) / h).otherwise(0.0)
        rise = F.get(to, k + 1) - F.get(to, k)
        bend = F.get(left, k) * h * (1 - t) * (1 - t) + t * (3 - 2 * t) * rise - F.get(right, k) * h * t * (1 - t)
        return F.get(to, k) + t * bend

    return _once(x, lambda v: _once(_position(keys, size, v), lambda k: piece(k, v)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out one time, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantile(d: Fitted, share: Column) -> Column:
    """Value below which this share of the draws lies."""
    return _once(share, lambda s: _quantile(d, s))


def _quantile(d: Fitted, share: Column) -> Column:
    x, below_, dens = (np.array(v) for v in d.knots)
    _, left, right = _slopes(x, below_, dens)
    place = _cubic(_array(below_), _array(x), _array(left), _array(right), len(x), share)
    if d.family.cdf is None:
        return F.greatest(F.lit(d.lo), F.least(F.lit(d.hi), place))
    total = d.whole[1] - d.whole[0]

    def polished(v: Column) -> Column:
        slope = pdf_column(d, v) / total
        better = v - (cdf_column(d, v) - share) / slope
        return F.when((slope > 0) & (better > d.lo) & (better < d.hi), better).otherwise(v)

    for _ in range(2):
        place = _once(place, polished)
    return place


def share_below(d: Fitted, x: Column) -> Column:
    """Share of the draws below ``x``."""
    at, share, dens = (np.array(v) for v in d.knots)
    secant = np.diff(share) / np.diff(at)
    left, right = np.minimum(dens[:-1], 3 * secant), np.minimum(dens[1:], 3 * secant)
    inside = F.greatest(F.lit(d.lo), F.least(F.lit(d.hi), x))
    return _cubic(_array(at), _array(share), _array(left), _array(right), len(at), inside)


def draws(spark: SparkSession, num: int, columns: dict[str, Fitted], seed: int = 7) -> DataFrame:
    """``num`` independent draws: rows (oid, columns)."""
    base = uniform_rows(spark, num, list(columns), seed)
    return base.select("oid", *[quantile(d, F.col(f"_r_{c}")).alias(c) for c, d in columns.items()])


def uniform_rows(spark: SparkSession, num: int, names: list[str], seed: int) -> DataFrame:
    """Rows (oid, _r_<name>) of independent uniforms.

    Each value depends on seed, name and oid alone, and Spark deals the rows out as it likes.
    """
    return with_uniforms(spark.range(num).withColumnRenamed("id", "oid"), seed, {f"_r_{c}": c for c in names})
