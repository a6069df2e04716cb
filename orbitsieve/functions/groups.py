"""Near-Earth groups and hazard labels as Column expressions."""

from pyspark.sql import Column, functions as F

from .. import constants as K


def aphelion() -> Column:
    return 2 * F.col("a") - F.col("q")


def is_atira() -> Column:
    return (F.col("a") <= 1.0) & (aphelion() <= K.EARTH_PERIHELION)


def is_aten() -> Column:
    return (F.col("a") <= 1.0) & (aphelion() >= K.EARTH_PERIHELION)


def is_apollo() -> Column:
    return (F.col("a") >= 1.0) & (F.col("q") <= K.EARTH_APHELION)


def is_amor() -> Column:
    return (F.col("a") > 1.0) & (F.col("q") > K.EARTH_APHELION) & (F.col("q") < K.AMOR_LIMIT)


GROUPS = {"atira": is_atira, "aten": is_aten, "apollo": is_apollo, "amor": is_amor}


def group_array() -> Column:
    """All groups an orbit is in; ties on a border belong to two groups."""
    return F.array_compact(F.array(*[F.when(rule(), F.lit(g)) for g, rule in GROUPS.items()]))


def group_slots() -> Column:
    """One slot per group, NULL where the orbit is not in it: explode, then drop the NULLs."""
    return F.array(*[F.when(rule(), F.lit(g)) for g, rule in GROUPS.items()])


def group_mask() -> Column:
    """The groups of an orbit as bits of a number, for grouping by a plain integer."""
    bits = [F.when(rule(), 1 << k).otherwise(0) for k, rule in enumerate(GROUPS.values())]
    return sum(bits[1:], bits[0])


def masked_groups(mask: str) -> Column:
    """Back from bits to one slot per group."""
    bit = lambda k: F.col(mask).bitwiseAND(1 << k) != 0
    return F.array(*[F.when(bit(k), F.lit(g)) for k, g in enumerate(GROUPS)])


def label_by_flag() -> Column:
    return F.when(F.col("pha") == "Y", 1).when(F.col("pha") == "N", 0)


def label_by_h(limit: float = K.HAZARD_H) -> Column:
    return F.when(F.col("h") < limit, 1).when(F.col("h") >= limit, 0)


def label_by_moid(limit: float = K.HAZARD_MOID) -> Column:
    return F.when(F.col("moid") <= limit, 1).when(F.col("moid") > limit, 0)
