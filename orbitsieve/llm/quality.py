"""Quality verdicts by robust multivariate distance, in DataFrame expressions only.

Fixed base rules reject short and self-repeating texts. For the rest, statistics of a text are turned
into a vector of damped logarithms (short texts are drawn to the usual values), and minimum-covariance-
determinant estimates are made per language and source: from medians and absolute deviations,
concentration steps keep the three quarters of a group's rows with the least distance until the kept
rows no longer change. Groups below ``GROUP_MIN`` rows use their language, small languages use all rows.
A text is rejected if its squared distance passes the chi-square quantile of ``tail``.

Vectors are whole thousandths and their sums exact, so results don't depend on how rows are dealt out.

A null text has no words and fails the base rules. Null language and source are groups like others. Rows
are judged one by one, repeated or not; ids don't matter.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitsieve.scratch import written

GROUP_MIN, SHARE, ROUNDS = 100, 0.75, 30
#: Steps between looks at whether estimates still change or alternate; even, so that both are seen.
LOOK = 2
NAMES = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each entry, in thousandths.
LEAST = (40, 150, 300, 300)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the counts of each text, row by row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "").alias("_words"))
    n = F.size("_words")
    word = F.col("_hashes")
    # equal windows of five words, found by sorting their hashes
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(word[i + j] for j in range(5)))))
    first = first.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.col("_text").contains("\n"), lines).alias("_lines"),
        windows.alias("_h"),
    )
    h = F.col("_h")
    third = second.withColumn("_again", F.coalesce(F.size(F.array_distinct(h)) < F.size(h), F.lit(False))).withColumn(
        "_sorted", F.when(F.col("_again"), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    s = F.col("_sorted")
    last = F.size(s) - 1
    same = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | ((j < last) & (s[F.least(j + 1, last)]["h"] == s[j]["h"])),
    )
    fourth = third.withColumn("_at", F.when(F.col("_again"), F.array_sort(F.transform(same, lambda j: s[j]["i"]))))
    at = F.col("_at")
    steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(5)))
    covered = F.when(F.col("_again"), F.aggregate(steps, F.lit(5), lambda x, y: x + y)).otherwise(0)
    n_words, repeat = F.col("n_words"), F.col("n_repeat_words")
    return fourth.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.coalesce(F.size("_lines"), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (n_words < 10) | (100 * repeat > 20 * n_words))


def vector() -> list[Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    parts = (
        F.log((chars + 100) / (n + 20)),
        F.log1p(100 * F.col("n_symbols") / (chars + 200)),
        F.log1p(20 * F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        F.log1p(20 * F.col("n_repeat_words") / (n + 100)),
    )
    return [F.round(1000 * p).cast("long").alias(x) for p, x in zip(parts, NAMES)]


def chi_tail(x: float, half: int) -> float:
    """P(chi-square of 2 * half degrees > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(half))


def chi_above(tail: float, half: int) -> float:
    """The value that chi-square passes with probability ``tail``."""
    low, high = 0.0, 1400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_tail(mid, half) > tail else (low, mid)
    return high


def scaled(groups: DataFrame, factor: float) -> DataFrame:
    """``groups`` with w**, the inverse of the Cholesky factor of ``factor`` times the covariance c**, to
    which the least variances are added; built up column by column, once per group."""
    p, names = len(NAMES), list(groups.columns)
    # a row travels as an array of one struct: each step binds it to a name, so nothing is multiplied out
    row = f"array(struct({', '.join(names)}))"

    def held(new):
        nonlocal row
        fields = [f"'{k}', x.{k}" for k in names] + [f"'{k}', {v}" for k, v in new.items()]
        row = f"transform({row}, x -> named_struct({', '.join(fields)}))"
        names.extend(new)

    def rest(i, j):
        less = "".join(f" - x.l{i}{k} * x.l{j}{k}" for k in range(j))
        return f"({factor!r}D * x.c{i}{j} + {LEAST[i] ** 2 if i == j else 0}D{less})"

    for j in range(p):  # column j of the factor, then row i of its inverse
        held({f"l{j}{j}": f"sqrt(greatest({rest(j, j)}, 1D))"})
        if j + 1 < p:
            held({f"l{i}{j}": f"{rest(i, j)} / x.l{j}{j}" for i in range(j + 1, p)})
    for i in range(p):
        less = lambda j, i=i: "".join(f" - x.l{i}{k} * x.w{k}{j}" for k in range(j, i))
        held({f"w{i}{j}": f"({1 if i == j else 0}D{less(j)}) / x.l{i}{i}" for j in range(i + 1)})
    return groups.selectExpr(f"inline({row})").drop(*(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def squared_distance() -> str:
    """Mahalanobis distance to a group's columns m* and w**, as SQL."""
    y = (" + ".join(f"w{i}{j} * ({NAMES[j]} - m{j})" for j in range(i + 1)) for i in range(len(NAMES)))
    return " + ".join(f"pow({v}, 2)" for v in y)


def _moments(rows: DataFrame) -> DataFrame:
    """Means m* and covariances c** per group; ``rows`` stand for ``n`` texts each or are sums of them."""
    p = range(len(NAMES))
    both = [(i, j) for i in p for j in range(i + 1)]
    total = lambda x: f"CAST(sum({x}) AS DOUBLE) AS {x}"
    moments = rows.groupBy("group").agg(F.expr("sum(n) AS n"), *(F.expr(total(f"s{i}")) for i in p), *(F.expr(total(f"s{i}{j}")) for i, j in both))
    return moments.selectExpr(
        "group", "n", *(f"s{i} / n AS m{i}" for i in p), *(f"s{i}{j} / n - s{i} / n * s{j} / n AS c{i}{j}" for i, j in both)
    )


def _concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One step: moments of the ``SHARE`` of each group's texts nearest to its estimates. Rows are summed
    by steps of the distance in their tasks, so only those sums are shuffled and ranked."""
    p = range(len(NAMES))
    weight = "CAST(n AS DECIMAL(19,0))"
    sums = [f"sum(CAST({NAMES[i]} AS DECIMAL(18,0)) * {weight}) AS s{i}" for i in p]
    sums += [f"sum(CAST({NAMES[i]} * {NAMES[j]} AS DECIMAL(18,0)) * {weight}) AS s{i}{j}" for i in p for j in range(i + 1)]
    near = rows.join(now.drop("n"), "group").select("group", "n", *NAMES, F.expr(f"floor(64 * log1p({squared_distance()}))").alias("far"))
    steps = near.groupBy("group", "far").agg(F.expr("sum(n) AS n"), *map(F.expr, sums))
    whole = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(whole.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.select("*", before.alias("_before"), F.sum("n").over(whole).alias("_all"))
    return _moments(ranked.where(f"_before <= floor({SHARE} * (_all - 1))"))


def estimates(stats: DataFrame) -> DataFrame:
    """(group, n, m*, c**) of each group with enough rows; see ``groups`` for their names.

    Equal vectors of a group are counted once, before anything is shuffled, and stay together with their
    count ``n``; a rounded vector has few values, so the steps read far fewer rows than there are texts."""
    rows = stats.where("not base_failed").select(*vector(), F.explode(F.array(*groups())).alias("group"))
    rows = written(rows.groupBy("group", *NAMES).agg(F.count("*").alias("n")), "vectors")
    # tables of groups are written, so that their true size decides how the vectors are joined to them
    sizes = rows.groupBy("group").agg(F.sum("n").alias("count")).where((F.col("count") >= GROUP_MIN) | (F.col("group") == "all")).select("group")
    rows = written(rows.join(written(sizes, "sizes"), "group"), "vectors")
    middle = written(rows.groupBy("group").agg(*(F.expr(f"percentile({x}, 0.5, n)").alias(f"m{i}") for i, x in enumerate(NAMES))), "middle")
    spread = rows.join(middle, "group").groupBy("group").agg(
        *(F.expr(f"percentile(abs({x} - m{i}), 0.5, n)").alias(f"d{i}") for i, x in enumerate(NAMES))
    )
    p = range(len(NAMES))
    start = middle.join(spread, "group").select(
        "group", *(f"m{i}" for i in p),
        *(((1.4826 * F.col(f"d{i}")) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in p if j <= i),
    )
    now, mark = written(scaled(start, 1.0).withColumn("n", F.lit(0)), "estimates"), None
    for step in range(ROUNDS):
        now = written(scaled(_concentrated(rows, now), 1.0), "estimates")
        if step % LOOK == LOOK - 1:  # what came back to a state two steps ago stays with it
            seen = now.agg(F.sum(F.xxhash64("group", "n", "m0", "m1", "m2", "m3").cast("decimal(38,0)"))).first()[0]
            if seen == mark:
                break
            mark = seen
    return now.drop(*(f"w{i}{j}" for i in p for j in range(i + 1)))


def groups() -> list[Column]:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source"))
    return [F.concat_ws("\t", F.lit("source"), lang, source), F.concat_ws("\t", F.lit("lang"), lang), F.lit("all")]


def judge(docs: DataFrame, tail: float = 1e-6, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, base_failed, kept, distance (squared, null if nothing could be estimated)
    and the group that it was taken to, one row per input row."""
    half = len(NAMES) // 2
    factor = SHARE / (1 - chi_tail(chi_above(1 - SHARE, half), half + 1))
    stats = written(statistics(docs, *dict.fromkeys([*keep, "lang", "source"])), "statistics")
    known = written(scaled(estimates(stats), factor), "estimates")
    rows = stats.select("*", *vector(), *(g.alias(f"_g{i}") for i, g in enumerate(groups())))
    names = known.select("group")
    for i in (0, 1):  # the finest group that has estimates
        rows = rows.join(names.withColumnRenamed("group", f"_k{i}"), F.col(f"_g{i}") == F.col(f"_k{i}"), "left")
    rows = rows.withColumn("group", F.coalesce("_k0", "_k1", "_g2")).join(known, "group", "left")
    far = F.expr(squared_distance())
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(far <= chi_above(tail, half), F.lit(True))).alias("kept"),
        far.alias("distance"), F.col("group").alias("judged_in"), *NAMES,
    )


def keep_good(docs: DataFrame, tail: float = 1e-6) -> DataFrame:
    """The input rows that are kept, with their columns."""
    marked = docs.withColumn("_mark", F.xxhash64("doc_id", "text", "lang", "source"))
    good = judge(marked, tail, ("doc_id", "_mark")).where("kept").select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_good")).distinct()
    return marked.join(good, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_good")), "left_semi").drop("_mark")
