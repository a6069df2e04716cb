"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitsieve.llm import (
    compact_windows, decontaminate, jaccard_join, language, line_chunks, merkle, norm_search, packing, pii, quality, secret_scan, suffix_dedup, winnowing,
)

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), 3, 90)


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.learn(docs.where(F.col("doc_id").isNotNull() & ~held))
    return language.predict(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op3_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@query
def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query
def op7_line_chunks(spark, sf_dir):
    return line_chunks.remove_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_compact_windows(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.lowered_third(table(spark, sf_dir, "documents")).drop("proof")


@query
def op11_winnowing(spark, sf_dir):
    rows = winnowing.compare_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", winnowing.as_text(F.col("marks")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


# Powers of the base for doubling runs of 1, 2, 4, 8 units to 16.
_POWERS = [pow(winnowing.BASE, 2**j, 2**64) for j in range(4)]
_DOUBLED = "units AS (SELECT doc_id, side, size, i, (unicode(c) + 1)::UHUGEINT AS g0 FROM letters)" + "".join(
    f""",
    g{j + 1} AS (SELECT doc_id, side, size, i,
      ((g{j} * {p}::UHUGEINT) % 18446744073709551616::UHUGEINT
       + COALESCE(LEAD(g{j}, {2**j}) OVER (PARTITION BY doc_id, side ORDER BY i), 0::UHUGEINT)) % 18446744073709551616::UHUGEINT AS g{j + 1}
      FROM {"units" if j == 0 else f"g{j}"})"""
    for j, p in enumerate(_POWERS)
)
ORACLE["op11_winnowing"] = f"""
WITH placed AS (
  SELECT doc_id, COALESCE(text, '') AS text, ROW_NUMBER() OVER (ORDER BY doc_id DESC) AS r, COUNT(*) OVER () AS n FROM documents),
sides AS (
  SELECT x.doc_id, y.doc_id AS next_id, x.text, LENGTH(x.text) AS n_chars,
    x.text[:(LENGTH(x.text) - LENGTH(x.text) // 2)] || y.text[:(LENGTH(x.text) // 2)] AS edited
  FROM placed x JOIN placed y ON y.r = x.r % x.n + 1),
texts AS (SELECT doc_id, 0 AS side, text FROM sides UNION ALL SELECT doc_id, 1, edited FROM sides),
letters AS (
  SELECT doc_id, side, LENGTH(text) AS size, UNNEST(RANGE(LENGTH(text))) AS i, UNNEST(STRING_SPLIT(text, '')) AS c FROM texts),
{_DOUBLED},
grams AS (
  SELECT doc_id, side, i, GREATEST(size - {winnowing.GRAM - 1}, 1) AS n,
    (((g4 * {winnowing.FINAL}::UHUGEINT) % 18446744073709551616::UHUGEINT) // 65536::UHUGEINT)::HUGEINT AS h
  FROM g4 WHERE i < GREATEST(size - {winnowing.GRAM - 1}, 1)),
least AS (
  SELECT doc_id, side, i, n, MIN(h * 4294967296::HUGEINT + (4294967295 - i)) OVER (
    PARTITION BY doc_id, side ORDER BY i ROWS BETWEEN CURRENT ROW AND {winnowing.WINDOW - 1} FOLLOWING) AS m FROM grams),
marks AS (
  SELECT DISTINCT doc_id, side, (m // 4294967296::HUGEINT)::BIGINT AS h, (4294967295 - m % 4294967296::HUGEINT)::BIGINT AS pos
  FROM least WHERE i < GREATEST(n - {winnowing.WINDOW - 1}, 1)),
listed AS (
  SELECT doc_id, side, STRING_AGG(FORMAT('{{:x}}', h) || ':' || pos, ',' ORDER BY pos) AS marks, COUNT(DISTINCT h) AS k
  FROM marks GROUP BY doc_id, side),
sets AS (SELECT DISTINCT doc_id, side, h FROM marks),
with_edited AS (
  SELECT a.doc_id, COUNT(*) AS both FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.h = b.h WHERE a.side = 0 AND b.side = 1 GROUP BY 1),
with_next AS (
  SELECT s.doc_id, COUNT(*) AS both FROM sides s JOIN sets a ON a.doc_id = s.doc_id AND a.side = 0
  JOIN sets b ON b.doc_id = s.next_id AND b.side = 0 AND a.h = b.h GROUP BY 1)
SELECT s.doc_id, s.n_chars, SHA256(s.edited) AS edited_sha256, COALESCE(a.marks, '') AS fingerprint,
  COALESCE(e.marks, '') AS edited_fingerprint,
  CASE WHEN COALESCE(a.k, 0) + COALESCE(e.k, 0) = 0 THEN 1e0
    ELSE COALESCE(we.both, 0)::DOUBLE / (COALESCE(a.k, 0) + COALESCE(e.k, 0) - COALESCE(we.both, 0)) END AS near_edited,
  CASE WHEN COALESCE(a.k, 0) + COALESCE(x.k, 0) = 0 THEN 1e0
    ELSE COALESCE(wn.both, 0)::DOUBLE / (COALESCE(a.k, 0) + COALESCE(x.k, 0) - COALESCE(wn.both, 0)) END AS near_next
FROM sides s LEFT JOIN listed a ON a.doc_id = s.doc_id AND a.side = 0 LEFT JOIN listed e ON e.doc_id = s.doc_id AND e.side = 1
LEFT JOIN listed x ON x.doc_id = s.next_id AND x.side = 0
LEFT JOIN with_edited we ON we.doc_id = s.doc_id LEFT JOIN with_next wn ON wn.doc_id = s.doc_id
"""


@query
def op12_norm_search(spark, sf_dir):
    return norm_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op12_norm_search"] = f"""
WITH doc_terms AS (SELECT doc_id, UNNEST({_TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, COUNT(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, SUM(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
whole AS (SELECT COUNT(*) AS docs, SUM(n)::BIGINT AS terms FROM sizes),
weights AS (
  SELECT term, FLOOR(1000 * LN((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, COUNT(*) AS df FROM tfs GROUP BY term), whole),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) * w AS gain
  FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
item_terms AS (SELECT item_id, UNNEST({_TERMS}) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, SUM(gain)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, doc_id),
places AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM places WHERE rank <= 10
"""


_SIZED = "COALESCE(OCTET_LENGTH(ENCODE({0})) || ':' || {0}, '-')"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "SHA256(" + " || ".join(_SIZED.format(f) for f in fields) + ")"


_SIDES = """COALESCE(STRING_AGG(digest, '') OVER ({0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    COALESCE(STRING_AGG(digest, '') OVER ({0} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE bits AS (
  SELECT UNNEST(RANGE(256)) AS b, UNNEST(RANGE(256))::BIGINT AS c, 0 AS k
  UNION ALL SELECT b, XOR(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crcs AS (
  SELECT DISTINCT doc_id, 0 AS k, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT x.doc_id, x.k + 1, XOR(x.c >> 8, b.c) FROM crcs x
  JOIN bits b ON b.k = 8 AND x.k < LENGTH(x.doc_id::VARCHAR) AND b.b = XOR(x.c, ASCII((x.doc_id::VARCHAR)[x.k + 1])) & 255),
tampered AS (SELECT doc_id, XOR(ARG_MAX(c, k), 4294967295) % 3 = 0 AS hit FROM crcs GROUP BY doc_id),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN hit THEN {_leaf_sql("TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS start
  FROM documents LEFT JOIN tampered USING (doc_id)),
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS spot, COUNT(*) OVER (PARTITION BY lang) AS n,
    DENSE_RANK() OVER (ORDER BY ENCODE(lang) NULLS FIRST) - 1 AS tree FROM leaves),
inner_nodes AS (
  SELECT tree, 0 AS level, spot, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, spot // 8, (n + 7) // 8, SHA256(STRING_AGG(digest, '' ORDER BY spot))
  FROM inner_nodes WHERE n > 1 GROUP BY tree, level, spot // 8, n),
subroots AS (SELECT tree, level, digest FROM inner_nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree AS spot, (SELECT COUNT(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, spot // 8, (n + 7) // 8, SHA256(STRING_AGG(digest, '' ORDER BY spot)) FROM upper WHERE n > 1 GROUP BY level, spot // 8, n),
inner_sides AS (SELECT tree, level, spot, {_SIDES.format("PARTITION BY tree, level, spot // 8 ORDER BY spot")} FROM inner_nodes WHERE n > 1),
upper_sides AS (SELECT level, spot, {_SIDES.format("PARTITION BY level, spot // 8 ORDER BY spot")} FROM upper WHERE n > 1),
steps AS (
  SELECT p.tree, p.spot, s.level AS step, s.before, s.after
  FROM placed p JOIN inner_sides s ON s.tree = p.tree AND s.spot = p.spot >> (3 * s.level)::INTEGER
  UNION ALL
  SELECT p.tree, p.spot, r.level + s.level, s.before, s.after
  FROM placed p JOIN subroots r ON r.tree = p.tree JOIN upper_sides s ON s.spot = p.tree >> (3 * s.level)::INTEGER),
folded AS (
  SELECT tree, spot, 0 AS step, start AS x FROM placed
  UNION ALL
  SELECT f.tree, f.spot, f.step + 1, SHA256(s.before || f.x || s.after) FROM folded f JOIN steps s ON s.tree = f.tree AND s.spot = f.spot AND s.step = f.step),
ends AS (SELECT tree, spot, ARG_MAX(x, step) AS folded_root FROM folded GROUP BY tree, spot),
proofs AS (SELECT tree, spot, SHA256(STRING_AGG(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, spot)
SELECT p.doc_id, p.leaf, r.digest AS subroot, u.digest AS root, COALESCE(q.proof, SHA256('')) AS proof_sha256,
  e.folded_root, e.folded_root = u.digest AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.spot = p.spot
LEFT JOIN proofs q ON q.tree = p.tree AND q.spot = p.spot, (SELECT digest FROM upper WHERE n = 1) u
"""
