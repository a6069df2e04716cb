"""Merkle manifest, winnowing and ranked search against plain versions, with edge rows and empty tables."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import pytest
from check_oracle import compare
from pyspark.sql import functions as F

from orbitsieve.llm import merkle, norm_search, winnowing
from orbitsieve.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (None, "Text without id", "xx", "s", 1), (1, None, None, None, None), (1, None, None, None, None), (2, "", "xx", None, 0),
    (3, "Word " * 30_000, None, "s", 5), (4, "\n\n\n", "yy", "s", 3), (4, "\n\n\n", "yy", "s", 3), (4, "Other text of id 4", "yy", "s", 3),
    (5, "Ä Ö ß 漢字 text 😀 more", "", "s", 9),
]


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = text.translate({i: i + 32 for i in range(65, 91)})
    values = [doc_id, source, lang, n_chars, text]
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(level, proofs):
    """Root of a list of (digest, members); appends siblings to the proof of each member."""
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 8):
            run = level[k : k + 8]
            for j, (_, members) in enumerate(run):
                for m in members:
                    proofs[m] += [([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]])]
            up.append((hashed(*[d for d, _ in run]), [m for _, members in run for m in members]))
        level = up
    return level[0]


def plain_manifest(rows):
    proofs = {i: [] for i in range(len(rows))}
    langs, subs, sub_of = {}, [], {}
    for i, r in enumerate(rows):
        langs.setdefault(r[2], []).append(i)
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(langs[lang], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf_of(rows[i])))
        subs.append(tree_of([(leaf_of(rows[i]), [i]) for i in own], proofs))
        sub_of |= {i: subs[-1][0] for i in own}
    root = tree_of(subs, proofs)[0]
    out = []
    for i, r in enumerate(rows):
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        x = leaf_of(r, bad)
        for before, after in proofs[i]:
            x = hashed(*before, x, *after)
        proof = hashed(*[d for p in proofs[i] for side in p for d in side])
        out.append((r[0], leaf_of(r), sub_of[i], root, proof, x, x == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("tree", "level", "at", "n", "mark", "digest", "first", "pid", "kids", "path"):
        df = df.withColumn(c, F.lit(1))
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in cols) for r in merkle.lowered_third(df).collect()), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        EDGES,
        EDGES[:1],
        [(i, f"Text {i}", "xx", "s", i) for i in range(8)],
        [(i * 7 % 700, f"Text {i} Of Many", ("xx", "yy", None)[min(i % 5, 2)], "s", i) for i in range(700)],
        [(i, f"Text {i}", f"lang{i % 75}" if i % 3 else "hot", "s", i) for i in range(200)],
    ],
    ids=["edges", "one", "one_run", "deep", "many_languages"],
)
def test_manifest_equals_plain_version(spark, rows):
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.lowered_third(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_marks(text):
    """Marks straight from the definition."""
    n = len(text)
    if not n:
        return []
    grams = []
    for i in range(max(n - winnowing.GRAM + 1, 1)):
        h = 0
        for j in range(winnowing.GRAM):
            h = (h * winnowing.BASE + (ord(text[i + j]) + 1 if i + j < n else 0)) % 2**64
        grams.append((h * winnowing.FINAL % 2**64) >> 16)
    out = set()
    for a in range(max(len(grams) - winnowing.WINDOW + 1, 1)):
        window = grams[a : a + winnowing.WINDOW]
        out.add((a + max(i for i, h in enumerate(window) if h == min(window)), min(window)))
    return [(h, p) for p, h in sorted(out)]


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprint_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé 漢😀") for _ in range(rng.choice((0, 1, 5, 15, 16, 17, 78, 79, 80, 150, 700)))) for _ in range(40)]
    return texts + ["ab" * 400, "x" * 300, "", None, texts[9], texts[9], "Word " * 900]


@pytest.mark.parametrize("ranges", [1, 3, 40, 90])
def test_winnowing_equals_plain_version(spark, ranges):
    texts = fingerprint_texts()
    df = spark.createDataFrame([(7 * i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for c in ("range", "more", "h", "major", "minor", "place", "marks"):
        df = df.withColumn(c, F.lit(1))
    got = {r.doc_id: r for r in winnowing.compare_edits(df, ranges).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after, half, r = plain[i - 1], len(t) // 2, got[7 * i]
        edited = t[: len(t) - half] + after[:half]
        marks, other = plain_marks(t), plain_marks(edited)
        assert [tuple(m) for m in r.marks] == marks and [tuple(m) for m in r.edited_marks] == other
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (likeness(marks, other), likeness(marks, plain_marks(after)))
    alone = {r.doc_id: r for r in winnowing.fingerprints(df).collect()}
    assert all(alone[d].marks == r.marks and alone[d].n_chars == r.n_chars for d, r in got.items())


def test_winnowing_in_pieces_and_its_guarantee(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abc ") for _ in range(5000))
    passage = "".join(rng.choice("abc ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    whole = [x.tolist() for x in winnowing.winnow([winnowing.code_points(t) for t in (text, "aa" * 2000, passage)])]
    monkeypatch.setattr(winnowing, "PIECE", 97)
    assert [x.tolist() for x in winnowing.winnow([winnowing.code_points(t) for t in (text, "aa" * 2000, passage)])] == whole
    for cut in (0, 1, 333, 4999):
        h, _, off = winnowing.winnow([winnowing.code_points(t) for t in (text[:cut] + passage + text[cut:], passage + "b" * 200)])
        assert set(h[: off[1]].tolist()) & set(h[off[1] :].tolist())


def test_winnowing_of_edge_rows(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    rows = winnowing.compare_edits(df, 4).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in rows) == sorted(
        (r[0] is not None, r[0] or 0, len(r[1] or "")) for r in EDGES
    )
    assert winnowing.compare_edits(df.limit(0)).collect() == [] and winnowing.fingerprints(df.limit(0)).collect() == []


def plain_ranking(docs, items, top=10):
    terms = lambda t: norm_search.TERM.findall((t or "").translate(norm_search.LOWERED))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total if total else 0
            gain = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            score = sum(gain(t) for t in terms(text) if t in b)
            if score > 0:
                rows.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def search_tables(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeß漢") for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 17, 70)))) for _ in range(120)]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice((10, 120))]).upper() if rng.random() < 0.2 else rng.choice(words[: rng.choice((10, 120))]) for _ in range(n))
    docs = [(i, pick(rng.choice((0, 1, 3, 20, 60, 400)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[8][1]), (8, docs[8][1]), (8, docs[8][1]), (2000, None), (2001, ""), (2002, " .,-\n"), (2003, pick(20_000))]
    items = [(i, pick(rng.choice((1, 4, 12, 40)))) for i in range(25)] + [(90, docs[7][1]), (91, docs[7][1]), (92, None), (93, ""), (None, words[3]), (94, "zzz")]
    return docs, items


@pytest.mark.parametrize("blocks", [4096, 9])
def test_search_equals_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(norm_search, "ITEMS", blocks)
    docs, items = search_tables(blocks)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for c in ("query", "rank", "score", "norm", "row", "n", "terms", "item_id"):
        left = left.withColumn(c, F.lit(1))
    got = norm_search.rank_documents(left, right.withColumn("doc_id", F.lit(5)).withColumn("score", F.lit(5))).collect()
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == plain_ranking(docs, items)


def test_search_buckets_lose_nothing(spark, monkeypatch):
    """With buckets of a few rows the bounds decide most rows."""
    monkeypatch.setattr(norm_search, "CELLS", 1)
    docs, items = search_tables(77)
    left = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = norm_search.rank_documents(left, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_ranking(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    items = spark.createDataFrame([(1, "text word"), (2, None)], "item_id long, text string")
    assert norm_search.rank_documents(docs.limit(0), items).collect() == []
    assert norm_search.rank_documents(docs, items.limit(0)).collect() == []
    assert norm_search.rank_documents(docs, items.where("item_id = 2")).collect() == []
    got = norm_search.rank_documents(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == plain_ranking([r[:2] for r in EDGES], [(1, "text word"), (2, None)])


@pytest.mark.parametrize("name", ["op11_winnowing", "op12_norm_search", "op13_merkle_manifest"])
def test_queries_on_the_test_tables(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()) == "ok"
