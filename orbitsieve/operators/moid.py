"""Smallest distance between each orbit and the orbit of the Earth.

Row-local: every orbit is solved where it lies, so a catalog of any size needs no shuffle, no
join with points of the Earth and no key that could be skewed. Columns go through Arrow in
batches and all orbits of a batch are solved together.

For a point of the orbit the nearest point of the Earth's nearly circular orbit lies almost
straight below it, which leaves a profile in one anomaly. All local minima of the profile are
kept (no cap) and polished in both anomalies by damped Newton steps.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .geometry import least_of_points

GRID = 256  # profile points around the orbit
FINE = 16  # points per profile cell when a minimum is looked at closely
BLOCK = 512  # orbits solved at a time, to stay in cache


def _ellipse(a, e, i, w, om):
    """Vectors p, q, c of r(E) = p cos E + q sin E + c, E the eccentric anomaly; angles in radians."""
    cw, sw, co, so, ci, si = np.cos(w), np.sin(w), np.cos(om), np.sin(om), np.cos(i), np.sin(i)
    to_perihelion = np.stack([co * cw - so * sw * ci, so * cw + co * sw * ci, sw * si])
    across = np.stack([-co * sw - so * cw * ci, -so * sw + co * cw * ci, cw * si])
    return a * to_perihelion, a * np.sqrt(1 - e * e) * across, -a * e * to_perihelion


_P2, _Q2, _C2 = (
    v.reshape(3, 1)
    for v in _ellipse(
        K.EARTH_A, K.EARTH_E, math.radians(K.EARTH_I), math.radians(K.EARTH_W), math.radians(K.EARTH_OM)
    )
)


def _profile(p, q, c, anomaly):
    """Squared distance to the Earth's orbit straight below, and the place in the ecliptic."""
    cos, sin = np.cos(anomaly), np.sin(anomaly)
    x, y, z = (p[k] * cos + q[k] * sin + c[k] for k in range(3))
    flat = np.sqrt(x * x + y * y)
    turn = math.radians(K.EARTH_W + K.EARTH_OM)
    # e cos of the true anomaly below, times ``flat``: the direction itself is only needed at minima
    ahead = K.EARTH_E * (x * math.cos(turn) + y * math.sin(turn))
    with np.errstate(invalid="ignore"):
        short = np.where(flat > 0, ahead / flat, K.EARTH_E * math.cos(turn))
    radius = K.EARTH_A * (1 - K.EARTH_E**2) / (1 + short)
    return (flat - radius) ** 2 + z * z, x, y


def _polish(p, q, c, s, t, rounds=40):
    """Minimise half the squared distance over both eccentric anomalies; all columns at once."""

    def gap(s, t):
        turns = [np.cos(s), np.sin(s), np.cos(t), np.sin(t)]
        d = p * turns[0] + q * turns[1] + c - (_P2 * turns[2] + _Q2 * turns[3] + _C2)
        return d, 0.5 * (d * d).sum(0), turns

    done = np.empty(s.shape)
    left = np.arange(len(s))  # columns that still move; the others are finished and out of the way
    d, value, turns = gap(s, t)
    damp = np.full(s.shape, 1e-4)
    for _ in range(rounds):
        cs, ss, ct, st = turns
        v1, a1 = q * cs - p * ss, -(p * cs + q * ss)
        v2, a2 = _Q2 * ct - _P2 * st, -(_P2 * ct + _Q2 * st)
        g1, g2 = (d * v1).sum(0), -(d * v2).sum(0)
        h11 = (v1 * v1).sum(0) + (d * a1).sum(0)
        h22 = (v2 * v2).sum(0) - (d * a2).sum(0)
        h12 = -(v1 * v2).sum(0)
        # Shift the Hessian until it is positive definite.
        mid, half = 0.5 * (h11 + h22), np.hypot(0.5 * (h11 - h22), h12)
        shift = np.maximum(0.0, 1e-12 - (mid - half)) * 1.5 + damp * mid.clip(1e-12)
        h11, h22 = h11 + shift, h22 + shift
        det = h11 * h22 - h12 * h12
        ds, dt = (h12 * g2 - h22 * g1) / det, (h12 * g1 - h11 * g2) / det
        size = np.maximum(np.abs(ds), np.abs(dt))
        cut = np.minimum(1.0, 0.1 / np.maximum(size, 1e-300))
        s_new, t_new = s + cut * ds, t + cut * dt
        d_new, new, turns_new = gap(s_new, t_new)
        better = new <= value
        s, t = np.where(better, s_new, s), np.where(better, t_new, t)
        d, value = np.where(better, d_new, d), np.where(better, new, value)
        turns = [np.where(better, n, o) for n, o in zip(turns_new, turns)]
        damp = np.where(better, damp * 0.1, damp * 10.0)
        moves = ~(size < 1e-11)
        if not moves.all():
            done[left[~moves]] = value[~moves]
            left, s, t, value, damp = left[moves], s[moves], t[moves], value[moves], damp[moves]
            p, q, c, d, turns = p[:, moves], q[:, moves], c[:, moves], d[:, moves], [x[moves] for x in turns]
            if not len(left):
                break
    done[left] = value
    return np.sqrt(2.0 * done)


def _solve(a, e, i, w, om):
    step = K.TWO_PI / GRID
    nodes = np.arange(GRID) * step
    p, q, c = _ellipse(a, e, i, w, om)
    f, _, _ = _profile(p[:, :, None], q[:, :, None], c[:, :, None], nodes)
    row, at = np.nonzero((f <= np.roll(f, 1, 1)) & (f <= np.roll(f, -1, 1)))
    # A cell may hold two close minima: look at it on a finer mesh.
    fine = nodes[at][:, None] + np.linspace(-step, step, 2 * FINE + 1)
    g, x, y = _profile(p[:, row, None], q[:, row, None], c[:, row, None], fine)
    edge = np.full((len(row), 1), np.inf)
    low = (g <= np.hstack([edge, g[:, :-1]])) & (g <= np.hstack([g[:, 1:], edge]))
    cand, at = np.nonzero(low)
    row, start = row[cand], fine[cand, at]
    true = np.arctan2(y[cand, at], x[cand, at]) - math.radians(K.EARTH_W + K.EARTH_OM)
    below = 2 * np.arctan2(
        math.sqrt(1 - K.EARTH_E) * np.sin(true / 2), math.sqrt(1 + K.EARTH_E) * np.cos(true / 2)
    )
    best = np.full(len(a), np.inf)
    np.minimum.at(best, row, _polish(p[:, row], q[:, row], c[:, row], start, below))
    return np.minimum(best, K.MOID_CEILING)


def _moid_udf():
    @F.pandas_udf("double")
    def moid(a: pd.Series, e: pd.Series, i: pd.Series, w: pd.Series, om: pd.Series) -> pd.Series:
        cols = [np.asarray(x, dtype=float) for x in (a, e, i, w, om)]
        cols[2:] = [np.radians(x) for x in cols[2:]]
        closed = np.isfinite(np.stack(cols)).all(0) & (cols[0] > 0) & (cols[1] >= 0) & (cols[1] < 1)
        out = np.full(len(a), np.nan)
        where = np.nonzero(closed)[0]
        for k in range(0, len(where), BLOCK):
            part = where[k : k + BLOCK]
            out[part] = _solve(*[x[part] for x in cols])
        return pd.Series(out)

    return moid


def moid(a="a", e="e", i="i", w="w", om="om") -> Column:
    """Distance in AU; NULL for open or unknown orbits."""
    d = _moid_udf()(*[F.col(x) if isinstance(x, str) else x for x in (a, e, i, w, om)])
    return F.nanvl(d, F.lit(None).cast("double"))


def append_moid(df: DataFrame) -> DataFrame:
    """Add or replace ``moid``."""
    return df.withColumn("moid", moid())


def moid_coarse(df: DataFrame, steps: int = 72) -> DataFrame:
    """Rows (oid, moid_coarse, theta): smallest distance to the Earth's orbit over ``steps`` points. One row per row."""
    turn = math.radians(K.EARTH_W + K.EARTH_OM)

    def away(t, x, y, z):
        earth = K.EARTH_A * (1 - K.EARTH_E**2) / (1 + K.EARTH_E * np.cos(np.arctan2(y, x) - turn))
        return (np.hypot(x, y) - earth) ** 2 + z * z, t

    near = least_of_points(np.arange(steps) * (K.TWO_PI / steps), away, "d2 double, theta double")
    d = df.select("oid", near().alias("p"))
    return d.select("oid", F.least(F.sqrt("p.d2"), F.lit(K.MOID_CEILING)).alias("moid_coarse"), "p.theta")
