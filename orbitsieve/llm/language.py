"""Language of texts by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it has a binary classifier, the log odds of hashed trigrams
between the languages with that bit set and those without. Trigram counts cover all training rows and
are the whole model. A second pass over them measures how often each bit is right for each language;
those rates weigh the losses in decoding. The codeword with the least weighted loss wins, and a text
whose second codeword is nearly as good is flagged as ambiguous.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing could be
learned. Rows with null language or id aren't learned from. Repeated rows count as often as they occur.
The number of languages is taken to be small: the model has BUCKETS numbers for each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm import text as tx

BUCKETS = 1 << 13
GAIN, SHARP, CLOSE = 6.0, 8.0, 0.15
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, off: np.ndarray):
    """Bucket of the trigram at each byte, BUCKETS where none counts, with letters folded."""
    x = FOLD[data]
    up = np.zeros(len(x), bool)
    up[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
    x = x + 32 * up.astype(np.uint8)
    out = np.full(len(x), BUCKETS, np.int64)
    if len(x) < 3:
        return out
    a, b, c = (x[i : len(x) - 2 + i].astype(np.uint32) for i in range(3))
    key = (a << 16) | (b << 8) | c
    key = (key * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    good = ((a == 32).astype(np.int8) + (b == 32) + (c == 32)) < 2
    left = np.repeat(off[1:], np.diff(off))[: len(a)] - np.arange(len(a))
    out[: len(a)] = np.where(good & (left >= 3), key, BUCKETS)
    return out


def codewords(k: int) -> np.ndarray:
    """+1/-1 codewords of k classes: all splits for up to 5, else the best of fixed random codes."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        rows = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1 << (k - 1)) if m]
        return np.array(rows, float).T
    width, rng, best = max(15, int(np.ceil(10 * np.log2(k)))), np.random.default_rng(7), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, width))
        gap = code @ code.T
        np.fill_diagonal(gap, -width)
        worst = (abs(code.sum(0)) == k).sum() * width + gap.max()
        if best is None or worst < best[0]:
            best = (worst, code)
    return best[1][:, abs(best[1].sum(0)) < k]


def _margins(weights, column):
    """Mean log odds of each bit for each text of a column."""
    for _, _, data, off in tx.blocks(column):
        g = grams(data, off)
        one = np.append(g, BUCKETS)
        n = len(off) - 1
        sums = np.zeros((n, weights.shape[1]), np.float64)
        full = np.flatnonzero(np.diff(off) > 0)
        if len(full):
            sums[full] = np.add.reduceat(weights[one], off[full], axis=0)
            count = np.add.reduceat((one < BUCKETS).astype(np.int64), off[full])
            sums[full] /= np.maximum(count, 1)[:, None]
        yield from sums


def learn(rows: DataFrame) -> dict:
    """Model from rows with text and lang."""
    tx.small_batches(rows.sparkSession)
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.groupBy("lang").count().collect())
    place = {x: i for i, x in enumerate(langs)}
    k = len(langs)

    def count(batches):
        total = np.zeros(k * (BUCKETS + 1), np.int64)
        for batch in batches:
            code = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, last, data, off in tx.blocks(batch.column(0)):
                of = np.repeat(code[first:last], np.diff(off))
                total += np.bincount(of * (BUCKETS + 1) + grams(data, off), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], ["slot", "n"])

    counts = np.zeros((k, BUCKETS + 1))
    for slot, n in rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[divmod(slot, BUCKETS + 1)] = n
    code = codewords(k)
    share = counts[:, :BUCKETS] + 0.5
    share /= share.sum(1, keepdims=True)
    odds = [np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0)) if (code[:, b] < 0).any() else np.zeros(BUCKETS) for b in range(code.shape[1])] if k else [np.zeros(BUCKETS)]
    weights = np.vstack([np.array(odds).T, np.zeros((1, len(odds)))]).astype(np.float32)

    def right(batches):
        good, seen = np.zeros((k, code.shape[1]), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            m = np.array(list(_margins(weights, batch.column(0))))
            of = np.array([place[x] for x in batch.column(1).to_pylist()])
            np.add.at(good, of, m * code[of] > 0)
            np.add.at(seen, of, 1)
        at = np.arange(k * code.shape[1])
        yield pa.record_batch([pa.array(at), pa.array(good.reshape(-1)), pa.array(np.repeat(seen, code.shape[1]))], ["slot", "good", "seen"])

    trust = np.ones((max(k, 1), len(odds)))
    if k > 1:
        for slot, good, seen in rows.mapInArrow(right, "slot long, good long, seen long").groupBy("slot").agg(F.sum("good"), F.sum("seen")).collect():
            trust[divmod(slot, code.shape[1])] = (good + 1) / (seen + 2)
    return {"langs": langs, "code": code, "weights": weights, "trust": trust / trust.sum(1, keepdims=True)}


def decode(model: dict, margins: np.ndarray):
    """Best language's place, its score and whether the second is close, of rows of margins."""
    z = GAIN * margins[:, None, :] * model["code"][None]
    loss = (np.logaddexp(0, -z) * model["trust"][None]).sum(2)
    soft = np.exp(-SHARP * (loss - loss.min(1, keepdims=True)))
    soft /= soft.sum(1, keepdims=True)
    best = soft.argmax(1)
    top = np.sort(soft, 1)
    close = top[:, -1] - top[:, -2] < CLOSE if soft.shape[1] > 1 else np.zeros(len(soft), bool)
    return best, soft[np.arange(len(best)), best], close


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1), ambiguous."""
    spark = tx.small_batches(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def rows(batches):
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = np.array([bool(m["langs"]) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            best, score, close = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known.any():
                best, score, close = decode(m, np.array(list(_margins(m["weights"], batch.column(1)))))
            names = [m["langs"][b] if k else "und" for b, k in zip(best, known)]
            yield pa.record_batch(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        rows, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def held_out(doc_id):
    """Whether a row belongs to the fold that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
