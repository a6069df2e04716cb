"""Least-squares fits of densities to histograms by Levenberg-Marquardt steps.

All columns, starting points and step lengths are tried at once: one round is one aggregate over the bins, whose
sums are the normal equations of every candidate. The driver solves systems of a few parameters.
"""

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.pdfs import Family

DAMPING = (0.03, 1.0, 30.0)  # factors of the damping tried in a round
ROUNDS = 20
GAIN, MOVE = 1e-3, 1e-7  # a fit has settled once a step gains or moves relatively less
STUCK = 1e9  # damping at which no shorter step is tried
SLOPE = 1e-6  # relative step of numeric derivatives


@dataclass
class _Search:
    """One starting point of one column: where it is, its normal equations, and what came of it."""

    name: str
    family: Family
    span: float
    theta: np.ndarray
    damping: float = 1e-2
    miss: float = math.inf
    grad: np.ndarray | None = None
    hess: np.ndarray | None = None
    status: str = ""
    tried: list = field(default_factory=list)

    def params(self, theta: np.ndarray) -> dict[str, float]:
        out = {}
        for p, t in zip(self.family.params, theta.tolist()):
            if p in self.family.positive:
                t = math.exp(min(max(t, -500.0), 500.0))
            elif p in self.family.share:
                t = 1 / (1 + math.exp(-min(max(t, -500.0), 500.0)))
            out[p] = t
        return out

    def steps(self, theta: np.ndarray) -> np.ndarray:
        least = [self.span if p in self.family.place else 1.0 for p in self.family.params]
        return SLOPE * np.maximum(np.abs(theta), least)

    def points(self, theta: np.ndarray) -> list[list[float]]:
        """Arguments at theta and a step up and down along each parameter."""
        moves = np.diag(self.steps(theta))
        at = [theta] + [theta + sign * m for m in moves for sign in (1, -1)]
        return [[float(v) for v in self.family.args(self.params(t))] for t in at]

    def propose(self) -> list[np.ndarray]:
        if self.hess is None:
            return [self.theta]
        out = []
        for factor in DAMPING:
            scaled = self.hess + self.damping * factor * np.diag(np.maximum(np.diag(self.hess), 1e-30))
            step = -np.linalg.lstsq(scaled, self.grad, rcond=None)[0]
            free = [p in self.family.positive or p in self.family.share for p in self.family.params]
            out.append(self.theta + np.where(free, np.clip(step, -2, 2), np.clip(step, -self.span * 5, self.span * 5) if self.family.place else step))
        return out

    def judge(self, results: list[tuple[float, np.ndarray, np.ndarray]]):
        """Take the best candidate if it gains, else shorten the steps."""
        best = int(np.argmin([r[0] for r in results]))
        miss, grad, hess = results[best]
        first = self.hess is None
        if not first and not miss < self.miss:
            self.damping *= 100
            if self.damping > STUCK:
                self.status = "settled"
            return
        theta = self.tried[best]
        moved = np.max(np.abs(theta - self.theta) / (self.steps(theta) / SLOPE))
        gained = self.miss - miss
        self.theta, self.miss, self.grad, self.hess = theta, miss, grad, hess
        if first:
            self.status = "" if math.isfinite(miss) and miss < 1e100 else "failed"
            return
        self.damping = max(self.damping * DAMPING[best], 1e-15)
        if gained <= GAIN * max(miss, 1e-300) or moved <= MOVE or miss < 1e-25:
            self.status = "settled"


def _sums(hist: DataFrame, searches: list[_Search]) -> dict[int, list]:
    """Misses and normal equations of all candidates of a round: one pass over the bins."""
    kinds, sizes, rows, of = [], [], [], []
    for s in searches:
        if s.family not in kinds:
            kinds.append(s.family)
            sizes.append(len(s.points(s.theta)[0]))
        for j, theta in enumerate(s.tried):
            points = [[min(max(v, -1e300), 1e300) for v in p] for p in s.points(theta)]
            rows.append({"id": len(rows), "name": s.name, "kind": kinds.index(s.family), "points": points, "steps": (2 * s.steps(theta)).tolist()})
            of.append((s, j))
    most = max(len(f.params) for f in kinds)
    # a few dozen candidates: one literal, no join
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<id:int,name:string,kind:int,points:array<array<double>>,steps:array<double>>>")
    finite = lambda v, other: F.when(F.isnan(v) | v.isNull() | (F.abs(v) > 1e100), F.lit(other)).otherwise(v)

    def density(point):
        value = F.lit(None).cast("double")
        for k, family in enumerate(kinds):
            args = [F.get(point, F.lit(j)) for j in range(sizes[k])]
            value = F.when(F.col("kind") == k, family.pdf(F.col("center"), *args)).otherwise(value)
        return value

    own = F.filter(table, lambda c: c["name"] == F.col("name"))
    rows = hist.select("center", "density", F.explode(own).alias("c")).select("center", "density", "c.*")
    rows = rows.select("id", "density", "steps", F.transform("points", density).alias("f"))
    at = lambda e: F.get("f", F.lit(e))
    slope = lambda k: (at(2 * k + 1) - at(2 * k + 2)) / F.get("steps", F.lit(k))
    rows = rows.select(
        "id", (finite(at(0), 1e75) - F.col("density")).alias("r"), *[F.coalesce(finite(slope(k), 0.0), F.lit(0.0)).alias(f"j{k}") for k in range(most)]
    )
    pairs = [(k, m) for k in range(most) for m in range(k, most)]
    sums = rows.groupBy("id").agg(
        F.sum(F.col("r") * F.col("r")).alias("miss"),
        F.array(*[F.sum(F.col(f"j{k}") * F.col("r")) for k in range(most)]).alias("grad"),
        F.array(*[F.sum(F.col(f"j{k}") * F.col(f"j{m}")) for k, m in pairs]).alias("hess"),
    )
    out = {}
    for r in sums.collect():
        s, j = of[r["id"]]
        n = len(s.family.params)
        hess = np.zeros((most, most))
        for (k, m), v in zip(pairs, r["hess"]):
            hess[k, m] = hess[m, k] = v
        out.setdefault(id(s), {})[j] = (r["miss"], np.array(r["grad"])[:n], hess[:n, :n])
    return out


def fit_bins(hist: DataFrame, jobs: dict[str, tuple[Family, list[dict[str, float]], float]]) -> dict[str, tuple[dict, float, str]]:
    """Parameters, sum of squares and status of each column of ``hist`` (name, center, density).

    ``jobs`` gives a column's family, starting points and range. A fit is ``settled``, or stopped by the ``limit``
    of rounds, or ``failed`` if its density is finite at no starting point.
    """
    searches = []
    for name, (family, starts, span) in jobs.items():
        inner = lambda p, v, f=family: math.log(v) if p in f.positive else math.log(v / (1 - v)) if p in f.share else v
        searches += [_Search(name, family, span, np.array([inner(p, s[p]) for p in family.params], float)) for s in starts]
    for round_ in range(ROUNDS):
        active = [s for s in searches if not s.status]
        if not active:
            break
        for s in active:
            s.tried = s.propose()
        sums = _sums(hist, active)
        for s in active:
            got = sums[id(s)]
            s.judge([got[j] for j in range(len(s.tried))])
        if round_ >= 4:  # the leaders of a column go on
            for name in jobs:
                own = sorted((s for s in searches if s.name == name and s.status != "failed"), key=lambda s: s.miss)
                for s in own[2:]:
                    s.status = s.status or "left"
    out = {}
    for name in jobs:
        best = min((s for s in searches if s.name == name), key=lambda s: s.miss)
        out[name] = (best.params(best.theta), float(best.miss), best.status or "limit")
    return out
