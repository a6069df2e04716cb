"""Documents that hold benchmark passages, found with spaced seeds, in DataFrame expressions only.

A mask hashes the words at its marked places and ignores the others, so a changed word spoils only the
seeds that mark it. All positions of all documents are hashed under each mask and joined to the seeds of
the benchmark. At each hit, document and item are laid side by side; they share a passage if in some
stretch of ``REACH`` words (or the whole of a shorter item) at least ``SIMILAR`` of the words agree. An item
uses as many of ``MASKS`` as it takes that every way in which so many words of its stretch can agree
leaves a seed, so no such passage is missed. Items below ``WORDS_MIN`` words can't be told from chance and are
left out.

The seeds are broadcast if there are at most ``SEEDS_MOST`` of them, which is counted first; beyond that
they are joined by a shuffle.

Null and empty texts hold nothing; null ids are reported like others; repeated rows once; other columns
are ignored.
"""

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from orbitsieve.scratch import written

# Fixed masks: 1 marks a word that is hashed.
MASKS = ("1111", "11101", "11011", "10111")
PLACES = [[j for j, c in enumerate(m) if c == "1"] for m in MASKS]
WORDS_MIN, SIMILAR, REACH, SEEDS_MOST = 5, 0.8, 16, 1_000_000


@cache
def masks_for(n: int) -> int:
    """How many of the masks leave a seed in whatever stretch of ``n`` words is similar enough."""
    agree = next(k for k in range(n + 1) if k >= SIMILAR * n)
    for many in range(1, len(MASKS) + 1):
        seeds = [{i + j for j in p} for p, m in zip(PLACES[:many], MASKS) for i in range(n - len(m) + 1)]
        if all(any(x.issuperset(s) for s in seeds) for x in map(set, combinations(range(n), agree))):
            return many
    raise ValueError(f"the masks miss passages of {n} words")


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _seeds(words: str, many: int) -> Column:
    """For each of the first ``many`` masks, the hashes at all positions."""
    n, h = F.size(words), F.col("_hashes")

    def at(kind):
        return lambda i: F.xxhash64(F.lit(kind), *(h[i + j] for j in PLACES[kind]))

    none = F.array().cast("array<bigint>")
    return F.array(*(
        F.when(n >= len(m), F.transform(F.sequence(F.lit(0), n - len(m)), at(k))).otherwise(none) for k, m in enumerate(MASKS[:many])
    ))


def _hashed(rows: DataFrame, words: str) -> DataFrame:
    return rows.withColumn("_hashes", F.transform(words, lambda x: F.xxhash64(x)))


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_same, n_compared, place): each document's best stretch of each item; ``place`` is
    the word of the document at which the item, laid beside it, starts. Rows with the same id count as one document."""
    best = _best(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select(
        "doc_id", "item_id", F.col("x.n_same").cast("long").alias("n_same"), (-F.col("x.less")).cast("long").alias("n_compared"),
        (-F.col("x.before")).cast("long").alias("place"),
    )


def _best(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_id, x): the best stretch of each item in each text (``mark`` is its hash)."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    items = benchmark.select("item_id", _words("text").alias("item")).where(F.size("item") >= WORDS_MIN)
    size = F.size("item")
    uses = F.get(F.lit([masks_for(n) for n in range(WORDS_MIN, REACH + 1)]), F.least(size, F.lit(REACH)) - WORDS_MIN)
    most = items.agg(F.max(uses)).first()[0] or 1
    seeds = (
        _hashed(items, "item").select("item_id", uses.alias("uses"), F.posexplode(_seeds("item", most)).alias("kind", "hashes"))
        .where("kind < uses").select("item_id", F.posexplode("hashes").alias("j", "seed"))
    )
    if seeds.count() <= SEEDS_MOST:
        seeds = F.broadcast(seeds)
    places = (
        _hashed(docs.select("doc_id", "mark", _words("text").alias("words")), "words")
        .select("doc_id", "mark", F.explode(_seeds("words", most)).alias("hashes"))
        .select("doc_id", "mark", F.posexplode("hashes").alias("i", "seed"))
    )
    hits = written(
        places.join(seeds, "seed").select("doc_id", "mark", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct(), "hits"
    )
    # rows without an id are told apart by their texts, and spread by them
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "text")
    mine = hits.join(items, "item_id").join(texts, here).withColumn("words", _words("text"))
    first = F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.size("words"), F.col("shift") + size) - first
    same = F.zip_with(
        F.slice("words", first + 1, length), F.slice("item", first - F.col("shift") + 1, length), lambda a, b: (a == b).cast("int")
    )
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    stretch = F.least(size, F.lit(REACH))
    good = (
        mine.where(length >= stretch).select("doc_id", "mark", "item_id", "shift", stretch.alias("stretch"), same.alias("same"))
        .where(F.exists(
            F.sequence(F.lit(0), F.size("same") - F.col("stretch")),
            lambda i: total(F.slice("same", i + 1, F.col("stretch"))) >= SIMILAR * F.col("stretch"),
        ))
        .select("doc_id", "mark", "item_id", total(F.col("same")).alias("n_same"), F.size("same").alias("n"), "shift")
    )
    best = F.max(F.struct("n_same", (-F.col("n")).alias("less"), (-F.col("shift")).alias("before")))
    return good.groupBy("doc_id", "mark", "item_id").agg(best.alias("x"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows whose texts hold no benchmark passage; rows that share an id, or have none, are judged one by one."""
    ident, mark = "_found", "_mark"
    while {ident, mark} & set(docs.columns):
        ident, mark = ident + "_", mark + "_"
    found = _best(docs, benchmark).select(F.col("doc_id").alias(ident), F.col("mark").alias(mark)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(docs["text"].cast("string")) == F.col(mark))
    return docs.join(found, same, "left_anti")
