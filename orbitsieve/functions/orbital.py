"""Orbit geometry as Column expressions; angles in columns are degrees, anomalies are radians."""

import math

from pyspark.sql import Column, functions as F

from .. import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def eccentricity(a="a", q="q") -> Column:
    return F.try_divide(_c(a) - _c(q), _c(a))


def semimajor(q="q", e="e") -> Column:
    """q / (1 - e); open orbits are first closed to e = 0.99."""
    closed = F.when(_c(e) >= 1.0, 0.99).otherwise(_c(e))
    return _c(q) / (1.0 - closed)


def period(a="a") -> Column:
    """Days."""
    cube = F.pow(_c(a) * K.AU_METRES, F.lit(3.0))
    return K.TWO_PI * F.sqrt(cube / (K.GRAVITY * K.SUN_MASS)) / K.DAY_SECONDS


def aphelion(a="a", q="q") -> Column:
    return 2 * _c(a) - _c(q)


def orbit_radius(t, a="a", e="e") -> Column:
    a, e = _c(a), _c(e)
    return a * (1 - e * e) / (1 + e * F.cos(_c(t)))


def orbit_point(t, a="a", e="e", i="i", w="w", om="om") -> Column:
    """Heliocentric point at true anomaly ``t`` as struct<x,y,z>."""
    r = orbit_radius(t, a, e)
    u = _c(t) + F.radians(_c(w))
    node, tilt = F.radians(_c(om)), F.radians(_c(i))
    return F.struct(
        (r * (F.cos(node) * F.cos(u) - F.sin(node) * F.sin(u) * F.cos(tilt))).alias("x"),
        (r * (F.sin(node) * F.cos(u) + F.cos(node) * F.sin(u) * F.cos(tilt))).alias("y"),
        (r * F.sin(u) * F.sin(tilt)).alias("z"),
    )


def orbit_point_rotation(t, a="a", e="e", i="i", w="w", om="om") -> Column:
    """The same point by turning the flat orbit about the node line, then about the z axis."""
    r = orbit_radius(t, a, e)
    u = _c(t) + F.radians(_c(w))
    flat_x, flat_y = r * F.cos(u), r * F.sin(u)
    node, tilt = F.radians(_c(om)), F.radians(_c(i))
    y, z = flat_y * F.cos(tilt), flat_y * F.sin(tilt)
    return F.struct(
        (flat_x * F.cos(node) - y * F.sin(node)).alias("x"),
        (flat_x * F.sin(node) + y * F.cos(node)).alias("y"),
        z.alias("z"),
    )


def earth_point(t) -> Column:
    return orbit_point(t, K.EARTH_A, K.EARTH_E, K.EARTH_I, K.EARTH_W, K.EARTH_OM)


def earth_radius_towards(x, y) -> Column:
    """Distance of the Earth's orbit from the Sun in the ecliptic direction of (x, y)."""
    turn = math.radians(K.EARTH_W + K.EARTH_OM)
    return orbit_radius(F.atan2(_c(y), _c(x)) - turn, K.EARTH_A, K.EARTH_E)


def node_distance(a="a", e="e", w="w") -> Column:
    """Distance from the Sun at the ascending node."""
    return orbit_radius(-F.radians(_c(w)), a, e)


def orbit_center(a="a", e="e", i="i", w="w", om="om") -> Column:
    """Centre of the ellipse as struct<x,y,z>: opposite to the perihelion, a*e from the Sun."""
    a, e, w = _c(a), _c(e), F.radians(_c(w))
    node, tilt = F.radians(_c(om)), F.radians(_c(i))
    return F.struct(
        (-a * e * (F.cos(node) * F.cos(w) - F.sin(node) * F.sin(w) * F.cos(tilt))).alias("x"),
        (-a * e * (F.sin(node) * F.cos(w) + F.cos(node) * F.sin(w) * F.cos(tilt))).alias("y"),
        (-a * e * F.sin(w) * F.sin(tilt)).alias("z"),
    )


def polyline_angle(k, n: int) -> Column:
    """Angle k of n + 1 around the orbit, denser towards the aphelion."""
    swing = math.pi * F.sin(_c(k) * (math.pi / n))
    return F.when(_c(k) <= n // 2, swing).otherwise(K.TWO_PI - swing)
