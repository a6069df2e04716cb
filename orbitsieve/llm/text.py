"""Array work on texts inside tasks: words, word hashes and shingles of whole Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are taken as UTF-8 bytes, so no Python object is made per
word. Hashes are polynomials in an odd base modulo 2**64, finished by a bit mixer.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def small_batches(spark):
    """Arrow batches of at most 8 MB, so that a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, off


def blocks(column, limit: int = CHUNK):
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes, one text at least."""
    data, off = text_bytes(column)
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, from the prefix sums of a block."""
    _, down = powers(len(sums))
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Start and end of each word, and the offset of each text in the list of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    gap = space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= gap[:-1]
    closes[:-1] |= gap[1:]
    starts = np.flatnonzero(opens & ~gap)
    ends = np.flatnonzero(closes & ~gap) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text; fewer words count as one shingle."""
    size = np.diff(off)
    n = len(hashes)
    place = np.arange(n) - np.repeat(off[:-1], size)
    total = np.repeat(size, size)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.where(place + j < total, padded[j : j + n], np.uint64(j + 1))
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + part)
    keep = (place + k <= total) | ((total < k) & (place == 0))
    counts = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def block_shingles(data: np.ndarray, off: np.ndarray, k: int, lower: bool = True):
    data = LOWER[data] if lower else data
    starts, ends, words = word_spans(data, off)
    return shingles(span_hashes(prefix_sums(data), starts, ends), words, k)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
