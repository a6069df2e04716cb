"""Probability densities as Column expressions over a column of x and columns of parameters.

A ``Family`` brings all that fitting and sampling need. ``FAMILIES`` names those that come with the library;
any other one can be passed in its place, and ``mixture`` makes new ones of old ones.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, functions as F

_ROOT_2PI = math.sqrt(2 * math.pi)


def normal(x: Column, loc: Column, scale: Column) -> Column:
    y = (x - loc) / scale
    return F.exp(-y * y / 2) / (scale * _ROOT_2PI)


def johnsonsb(x, a, b, loc, scale) -> Column:
    y = (x - loc) / scale
    g = a + b * F.ln(y / (1 - y))
    return F.when(
        (y > 0) & (y < 1), b / (scale * y * (1 - y) * _ROOT_2PI) * F.exp(-g * g / 2)
    ).otherwise(0.0)


def exponweib(x, a, c, loc, scale) -> Column:
    y = (x - loc) / scale
    power = F.pow(y, c)
    return F.when(
        y > 0, a * c / scale * F.pow(-F.expm1(-power), a - 1) * F.exp(-power) * F.pow(y, c - 1)
    ).otherwise(0.0)


def pearson3(x, skew, loc, scale, lgamma) -> Column:
    """``lgamma`` is ln Gamma(4 / skew^2), worked out where the parameters are made."""
    shape = 4.0 / (skew * skew)
    # Gamma variable behind the shifted and scaled one.
    t = 2.0 / skew * ((x - loc) / scale + 2.0 / skew)
    return F.when(
        t > 0, 2.0 / F.abs(skew) / scale * F.exp((shape - 1) * F.ln(t) - t - lgamma)
    ).otherwise(0.0)


def harmonic(x, amp, phase, shift) -> Column:
    return amp * F.sin(2 * F.radians(x) + phase) + shift


def uniform(x, lo, hi) -> Column:
    return F.when((x >= lo) & (x <= hi), 1.0 / (hi - lo)).otherwise(0.0)


@dataclass(frozen=True)
class Moments:
    """What starting points are made of: range, mean and standard deviation of a column."""

    lo: float
    hi: float
    mean: float
    std: float

    @property
    def span(self) -> float:
        return self.hi - self.lo


@dataclass(frozen=True)
class Family:
    """A density with named parameters.

    ``starts`` gives the points that a fit starts from; parameters in ``positive`` and ``share`` stay above 0 and
    between 0 and 1; those in ``place`` are measured like x. ``extra`` works out further arguments of ``pdf``
    from the parameters. ``cdf``, where there is a formula, makes draws exact.
    """

    params: tuple[str, ...]
    pdf: Callable[..., Column]
    starts: Callable[[Moments], list[dict[str, float]]]
    positive: tuple[str, ...] = ()
    share: tuple[str, ...] = ()
    place: tuple[str, ...] = ("loc",)
    extra: Callable[..., list[float]] = field(default=lambda **params: [])
    cdf: Callable[..., Column] | None = None

    def args(self, params: dict[str, float]) -> list[float]:
        """Arguments of ``pdf`` and ``cdf`` after x."""
        return [params[p] for p in self.params] + self.extra(**params)


def mixture(*parts: Family) -> Family:
    """Two or more densities with free shares; part k has its parameters under ``<name>_k`` from 1 on.

    ``share_k`` is what part k takes of all that the parts before it left.
    """
    named = [{p: f"{p}_{k}" for p in part.params} for k, part in enumerate(parts, 1)]
    shares = tuple(f"share_{k}" for k in range(1, len(parts)))
    of = lambda kind: tuple(n[p] for part, n in zip(parts, named) for p in getattr(part, kind))
    own = lambda k, params: {p: params[n] for p, n in named[k].items()}

    def starts(m: Moments):
        """Part k starts on the k-th piece of the range."""
        width, out = m.span / len(parts), []
        pieces = [Moments(m.lo + k * width, m.lo + (k + 1) * width, m.lo + (k + 0.5) * width, width / 4) for k in range(len(parts))]
        for picks in product(*(part.starts(piece)[:2] for part, piece in zip(parts, pieces))):
            point = {s: 1 / (len(parts) - k) for k, s in enumerate(shares)}
            out.append(point | {n[p]: v for n, pick in zip(named, picks) for p, v in pick.items()})
        return out

    def combined(kind):
        def at(x, *args):
            rest, total, used = F.lit(1.0), F.lit(0.0), len(shares)
            for k, part in enumerate(parts):
                size = len(part.params) + extras[k]
                part_of_it = rest * args[k] if k < len(shares) else rest
                rest = rest - part_of_it
                total = total + part_of_it * getattr(part, kind)(x, *args[used : used + size])
                used += size
            return total

        return at

    extras = [len(part.extra(**part.starts(Moments(0.0, 1.0, 0.5, 0.25))[0])) for part in parts]
    grouped = [p for part, n in zip(parts, named) for p in n.values()]

    class _Mixture(Family):
        def args(self, params):
            return [params[s] for s in shares] + [v for k, part in enumerate(parts) for v in part.args(own(k, params))]

    return _Mixture(
        (*shares, *grouped), combined("pdf"), starts, of("positive"), (*shares, *of("share")), of("place"),
        cdf=combined("cdf") if all(p.cdf for p in parts) else None,
    )


def exponweib_cdf(x, a, c, loc, scale) -> Column:
    y = (x - loc) / scale
    return F.when(y > 0, F.pow(-F.expm1(-F.pow(y, c)), a)).otherwise(0.0)


def harmonic_cdf(x, amp, phase, shift) -> Column:
    return amp * 90 / math.pi * (F.cos(phase) - F.cos(2 * F.radians(x) + phase)) + shift * x


def uniform_cdf(x, lo, hi) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def bimodal(x, offset, loc, scale) -> Column:
    return 0.5 * normal(x, loc, scale) + 0.5 * normal(x, offset, scale)


def _choices(**values) -> list[dict[str, float]]:
    return [dict(zip(values, picks)) for picks in product(*values.values())]


FAMILIES = {
    "normal": Family(
        ("loc", "scale"), normal, lambda m: _choices(loc=[m.mean, m.mean - m.std, m.mean + m.std], scale=[m.std, m.std / 4]), ("scale",)
    ),
    "johnsonsb": Family(
        ("a", "b", "loc", "scale"), johnsonsb,
        lambda m: _choices(a=[-1.0, 0.3, 1.5], b=[0.6, 1.4], loc=[m.lo - 0.05 * m.span, m.lo - 0.3 * m.span], scale=[1.2 * m.span, 2.0 * m.span]),
        ("b", "scale"),
    ),
    "exponweib": Family(
        ("a", "c", "loc", "scale"), exponweib,
        lambda m: _choices(a=[0.6, 1.5], c=[0.8, 1.6, 3.0], loc=[m.lo - 0.02 * m.span, m.lo - 0.2 * m.span], scale=[m.std, 2.5 * m.std]),
        ("a", "c", "scale"), cdf=exponweib_cdf,
    ),
    "pearson3": Family(
        ("skew", "loc", "scale"), pearson3, lambda m: _choices(skew=[-1.2, -0.4, 0.4, 1.2], loc=[m.mean], scale=[m.std, 1.6 * m.std]),
        ("scale",), extra=lambda skew, **_: [math.lgamma(4.0 / (skew * skew)) if skew else math.inf],
    ),
    "harmonic": Family(
        ("amp", "phase", "shift"), harmonic, lambda m: _choices(amp=[0.2 / m.span], phase=[0.0, 2.1, 4.2], shift=[1 / m.span]), place=(),
        cdf=harmonic_cdf,
    ),
    "bimodal": Family(
        ("offset", "loc", "scale"), bimodal,
        lambda m: _choices(offset=[m.mean + m.std, m.mean + m.span / 4], loc=[m.mean - m.std, m.mean - m.span / 4], scale=[m.std / 2, m.span / 12]),
        ("scale",), place=("offset", "loc"),
    ),
    "uniform": Family(("lo", "hi"), uniform, lambda m: [{"lo": m.lo, "hi": m.hi}], place=("lo", "hi"), cdf=uniform_cdf),
}
