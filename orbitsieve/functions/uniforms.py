"""Uniform draws as a function of seed, name and key, in arithmetic that any SQL engine has.

A draw is two 32-bit hashes of the key (its low, then its high half, mixed with round keys of seed and name),
joined to 53 bits. Products stay below 2**63, so nothing overflows.
"""

import zlib

from pyspark.sql import DataFrame, functions as F

WORD = (1 << 32) - 1
# Multipliers of the bit mixer and its shifts.
FIRST, SECOND = 0x21F0AAAD, 0x735A2D97
SHIFTS = (16, 15, 15)


def _mixed(x: int) -> int:
    x ^= x >> SHIFTS[0]
    x = x * FIRST & WORD
    x ^= x >> SHIFTS[1]
    x = x * SECOND & WORD
    return x ^ x >> SHIFTS[2]


def _round_keys(seed: int, name: str) -> list[int]:
    keys, x = [], zlib.crc32(f"{seed}/{name}".encode())
    for _ in range(4):
        x = _mixed((x + 0x9E3779B9) & WORD)
        keys.append(x)
    return keys


def with_uniforms(df: DataFrame, seed: int, names: dict[str, str], key: str = "oid") -> DataFrame:
    """Add a double in [0, 1) for each name (column -> stream), a function of the integer column ``key``.

    Each step is a projection of its own, as it uses the step before twice."""
    key = F.col(key).cast("long")
    low, high = key.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(key, 32)
    word = lambda x: x.bitwiseAND(F.lit(WORD))
    shifted = lambda x, by: x.bitwiseXOR(F.shiftrightunsigned(x, by))
    lanes = {}
    for name, stream in names.items():
        a, b, c, d = _round_keys(seed, stream)
        lanes |= {f"_{name}_1": (a, b), f"_{name}_2": (c, d)}
    mixing = [lambda x, _: word(shifted(x, SHIFTS[0]) * FIRST), lambda x, _: word(shifted(x, SHIFTS[1]) * SECOND)]
    turn = lambda x, k: word(shifted(x, SHIFTS[2]).bitwiseXOR(high) + k[1])
    df = df.withColumns({x: word(low + k[0]) for x, k in lanes.items()})
    for step in (*mixing, turn, *mixing, lambda x, _: shifted(x, SHIFTS[2])):
        df = df.withColumns({x: step(F.col(x), k) for x, k in lanes.items()})
    joined = lambda n: (F.col(f"_{n}_1") * F.lit(1 << 21) + F.shiftrightunsigned(f"_{n}_2", 11)) / F.lit(float(1 << 53))
    return df.withColumns({n: joined(n) for n in names}).drop(*lanes)


def uniform_sql(seed: int, name: str, key: str = "oid") -> str:
    """The same double as an SQL scalar over ``key`` (nested selects name each step once)."""

    def mix(x: str) -> str:
        for factor, shift in ((None, SHIFTS[0]), (FIRST, SHIFTS[1]), (SECOND, SHIFTS[2])):
            x = x if factor is None else f"(({x}) * {factor} & {WORD})"
            x = f"LIST_TRANSFORM([{x}], lambda v: XOR(v, v >> {shift}))[1]"
        return x

    a, b, c, d = _round_keys(seed, name)
    words = [mix(f"((XOR({mix(f'(({key} & {WORD}) + {p}) & {WORD}')}, {key} >> 32) + {q}) & {WORD})") for p, q in ((a, b), (c, d))]
    return f"(({words[0]} * {1 << 21} + ({words[1]} >> 11))::DOUBLE / {float(1 << 53)!r})"
