"""Personal data in texts: fixed base kinds, and boosted trees over further candidates; DataFrame
expressions and Spark ML only.

Base spans come from patterns with checks (address parts, check digits, number of digits) and always
stay. High-recall generators propose more spans, which may overlap: numbers with separators, and mail
addresses written out. Boosted trees see the format of a candidate and the words around it; candidates
that agree with a base span are examples of personal data, the others are counter-examples. The lowest
threshold at which held-out precision is at least ``PRECISION`` selects spans, unless they overlap a base
span. All candidates are used: a hash of span and place holds out a quarter for the threshold, the trees learn from
the rest, and scoring takes all.

A null text is empty. Rows are independent; repeated rows and null ids are reported as they come; other
columns are ignored. With no examples of either sort nothing is added.
"""

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from orbitsieve.scratch import written

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with quantifiers that never need to go back marked as such.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PROPOSE = {
    "number": r"\+?+[0-9(](?:[\x20().\x2F-]?+[0-9()])++",
    "written": r"[A-Za-z0-9._%+-]+[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9.-]+(?:[\x20]?[\[(]dot[\])][\x20]?[A-Za-z]{2,})*",
}
HINTS = ("tel", "phone", "call", "fax", "mail", "contact", "card", "visa", "ssn", "iban", "ip", "version", "page", "no.")
PRECISION, TREES, DEPTH = 0.99, 12, 4
SPANS = "array<struct<start:int,end:int,text:string>>"


def spans(text: Column, pattern: str, when: Column) -> Column:
    """Leftmost, non-overlapping matches with their places in code points."""
    cuts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.transform(cuts, F.length).alias("before"), found.alias("text"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["before"] + F.length(x["text"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["before"]).alias("start"), (acc["at"] + x["before"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    out = F.aggregate(F.filter(pairs, lambda x: x["text"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(when & (F.size(found) > 0), out).otherwise(F.array().cast(SPANS))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["text"])


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("span"))


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text and an array of valid spans per base kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text")).withColumn("_digit", F.col("text").rlike("[0-9]"))
    for kind in KINDS:
        when = F.col("text").contains(NEEDS[kind]) if kind == "email" else F.col("_digit") & F.col("text").contains(NEEDS[kind])
        rows = rows.withColumn(kind, spans(F.col("text"), PATTERNS[kind], when))
    return rows.select(*keep, "text", "_digit", *(F.filter(k, _check(k)).alias(k) for k in KINDS))


def candidates(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per proposed span: place, format and context features, whether it is a base span."""
    text = F.col("text")
    hint = F.col("_digit") | text.rlike(r"(?i)[\[(]at[\])]")
    found = F.concat(
        *(F.transform(spans(text, p, hint), _named(n)) for n, p in PROPOSE.items()),
        F.transform("email", _named("email")),
    )
    every = F.concat(*KINDS)
    out = (
        rows.where(hint | F.col("text").contains("@")).withColumn("_found", found).withColumn("_base", every)
        .select(*keep, "_base", "text", F.explode("_found").alias("x")).select(*keep, "_base", "text", "x.*")
        .where((F.length(F.regexp_replace("span", "[^0-9]", "")) >= 6) | F.col("kind").isin("written", "email"))
    )
    near = lambda a: F.exists("_base", lambda s: a(s))
    before = F.lower(F.substring(F.col("text"), F.greatest(F.col("start") - 23, F.lit(1)), F.least(F.col("start"), F.lit(24))))
    after = F.substring(F.col("text"), F.col("end") + 1, F.lit(1))
    return out.select(
        *keep, "kind", "start", "end", "span", before.alias("before"), after.alias("after"),
        near(lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])).alias("overlaps"),
        near(lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"])).cast("double").alias("label"),
    )


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    span, digits = F.col("span"), F.regexp_replace("span", "[^0-9]", "")
    count = lambda p: F.regexp_count(span, F.lit(p)).cast("double")
    parts = F.split(F.regexp_replace(span, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    cols = {
        "f_len": F.length("span").cast("double"), "f_digits": F.length(digits).cast("double"), "f_letters": count("[A-Za-z]"),
        "f_dots": count(r"\."), "f_dashes": count("-"), "f_blanks": count(" "), "f_round": count(r"[()]"), "f_slash": count("/"),
        "f_plus": count(r"^\+"), "f_at": count("@|[(\\[]at[)\\]]"), "f_parts": F.size(parts).cast("double"),
        "f_longest": F.array_max(F.transform(parts, F.length)).cast("double"), "f_shortest": F.array_min(F.transform(parts, F.length)).cast("double"),
        "f_luhn": luhn(digits).cast("double"), "f_glued": F.col("before").rlike(r"[A-Za-z0-9=_/#\"]$").cast("double"),
        "f_tail": F.col("after").rlike(r"[A-Za-z0-9_/#\"]").cast("double"),
        "f_hint": reduce(lambda a, b: a + b, (F.col("before").contains(h).cast("double") for h in HINTS[:11])),
        "f_counter": reduce(lambda a, b: a + b, (F.col("before").contains(h).cast("double") for h in HINTS[11:])),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()}), list(cols)


def selected(rows: DataFrame) -> DataFrame | None:
    """Candidates beside the base spans that the trees accept; None if there is nothing to learn from."""
    rows, names = features(rows)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names, "before", "after")
    rows = written(rows.withColumn("held", F.pmod(F.xxhash64("span", "start"), F.lit(4)) == 0), "candidates")
    seen = {(r["label"], r["held"]) for r in rows.groupBy("label", "held").count().collect()}
    if not {(0.0, False), (1.0, False), (1.0, True)} <= seen:
        return None
    train = rows.where("not held").select("label", "features")
    model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False).fit(train)
    score = F.round(vector_to_array("probability")[1], 4)
    held = (
        model.transform(rows.where("held").select("label", "features")).groupBy(score.alias("score"))
        .agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    )
    good = total = 0
    threshold = None
    for r in held:
        good, total = good + r["good"], total + r["n"]
        if good >= PRECISION * total:
            threshold = r["score"]
    if threshold is None:
        return None
    return model.transform(rows.where("not overlaps")).where(score >= threshold).drop("held", "features", "rawPrediction", "probability", "prediction")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, an array of spans per base kind, ``more`` (added spans)."""
    marked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_mark"))
    rows = base_spans(marked, "doc_id", "_mark")
    kept = written(rows.select("doc_id", "_mark", *KINDS), "base")
    more = selected(candidates(rows, "doc_id", "_mark"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    if more is None:
        return kept.drop("_mark").withColumn("more", none)
    span = F.struct("kind", "start", "end", F.col("span").alias("text"))
    more = more.groupBy("doc_id", "_mark").agg(F.sort_array(F.collect_set(span)).alias("more")).withColumnsRenamed({"doc_id": "_id", "_mark": "_m"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m"))
    return kept.join(more, same, "left").select("doc_id", *KINDS, F.coalesce("more", none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    line = lambda k, c: F.transform(c, lambda x: F.concat_ws(":", k if k is not None else x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*(line(F.lit(k), F.col(k)) for k in KINDS))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, line(None, F.col("more"))), ",").alias("spans"),
    )
