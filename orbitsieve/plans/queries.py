"""Registered queries over the orbits fixture, each with the SQL a second engine can check it by.

Doubles are rounded to six digits on both sides; nothing else is changed for the comparison.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import orbital as O
from ..operators import augment, filters, geometry, histogram, moid, quality, scaling
from ..sources import catalog
from ..sources.fixture import ORBITS_SQL, orbits
from ..scratch import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The fixture as the head of every SQL check, under the name ``orbits``.
_HEAD = "WITH orbits AS (" + ORBITS_SQL.format(lineitem="lineitem") + ")"


def sql(body: str, *ctes: str) -> str:
    return _HEAD + "".join(f",\n{c}" for c in ctes) + "\n" + body


def r6(**cols: str) -> str:
    """Rounded SQL columns: name=expression."""
    return ", ".join(f"ROUND({e}, 6) + 0e0 AS {n}" for n, e in cols.items())


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


LABEL_FLAG = "CASE pha WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END"
LABEL_MOID = "CASE WHEN moid <= 0.05e0 THEN 1 WHEN moid > 0.05e0 THEN 0 END"
IS_ATIRA = "a <= 1.0e0 AND 2*a - q <= 0.983e0"
IS_ATEN = "a <= 1.0e0 AND 2*a - q >= 0.983e0"
IS_APOLLO = "a >= 1.0e0 AND q <= 1.017e0"
IS_AMOR = "a > 1.0e0 AND q > 1.017e0 AND q < 1.3e0"
LABELLED = f"lab AS (SELECT *, {LABEL_FLAG} AS label FROM orbits WHERE pha IS NOT NULL)"
TAGS = " UNION ALL ".join(
    f"SELECT *, '{g}' AS grp FROM {{src}} WHERE {cond}"
    for g, cond in (("atira", IS_ATIRA), ("aten", IS_ATEN), ("apollo", IS_APOLLO), ("amor", IS_AMOR))
)
# A rule in place of a trained classifier, for reports that only need some prediction.
RULE_SQL = "CASE WHEN q > 0.6e0 AND q < 1.05e0 AND i < 20e0 THEN 1 ELSE 0 END"


def rule_prediction():
    return F.when((F.col("q") > 0.6) & (F.col("q") < 1.05) & (F.col("i") < 20), 1).otherwise(0)


def labelled_orbits(spark, sf) -> DataFrame:
    return filters.haz_by_flag(orbits(spark, sf))


# --- sources ---------------------------------------------------------------------------------


@query("scan_catalog", sql(f"SELECT oid, neo, pha, {r6(a='a', q='q', h='h')} FROM orbits"))
def scan_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    orbits(spark, sf).write.option("header", True).csv(path)
    return rounded(catalog.scan_catalog(spark, path, ["oid", "neo", "pha", "a", "q", "h"]))


def _domains():
    """Stand-in domain borders; the real ones are the user's."""
    return [F.col("q") <= 0.6, (F.col("q") <= 1.0) & (F.col("i") < 20), F.col("w") > 180]


_DOMAIN_SQL = (
    "CASE WHEN q <= 0.6e0 THEN 1 WHEN q <= 1.0e0 AND i < 20 THEN 2 WHEN w > 180 THEN 3 END"
)


@query(
    "dataset_io",
    sql(f"SELECT oid, origin, {r6(a='a', w='w')} FROM orbits WHERE ({_DOMAIN_SQL}) = 2 AND origin = 'gen'"),
)
def dataset_io(spark, sf):
    path = scratch_path(spark, "dataset")
    catalog.save_dataset(filters.domain_split(orbits(spark, sf), _domains()), path)
    return rounded(catalog.load_dataset(spark, path, 2, "gen").select("oid", "origin", "a", "w"))


@query("preview", sql(f"SELECT oid, origin, {r6(a='a', e='e', i='i')} FROM orbits ORDER BY oid LIMIT 10"))
def preview(spark, sf):
    return rounded(catalog.preview(orbits(spark, sf).select("oid", "origin", "a", "e", "i")))


# --- filters, labels, splits -----------------------------------------------------------------


@query("cut_magnitude", sql(f"SELECT oid, {r6(h='h')} FROM orbits WHERE h < 22e0"))
def cut_magnitude(spark, sf):
    return rounded(filters.cut_magnitude(orbits(spark, sf)).select("oid", "h"))


@query("cut_magnitude_over", sql(f"SELECT oid, {r6(h='h')} FROM orbits WHERE h >= 20e0"))
def cut_magnitude_over(spark, sf):
    return rounded(filters.cut_magnitude(orbits(spark, sf), "over", 20.0).select("oid", "h"))


@query(
    "get_neas",
    sql("SELECT oid, pha FROM orbits WHERE neo = 'Y' AND pha IS NOT NULL AND moid IS NOT NULL"),
)
def get_neas(spark, sf):
    return filters.get_neas(orbits(spark, sf), ["pha", "moid"]).select("oid", "pha")


@query(
    "get_neas_count",
    sql("SELECT CAST(COUNT(*) AS BIGINT) AS n FROM orbits WHERE neo = 'Y' AND pha IS NOT NULL"),
)
def get_neas_count(spark, sf):
    return filters.get_neas(orbits(spark, sf), ["pha"]).agg(F.count("*").alias("n"))


def _group_query(name, fn, cond):
    @query(name, sql(f"SELECT oid, {r6(a='a', q='q')} FROM orbits WHERE {cond}"))
    def run(spark, sf):
        return rounded(fn(orbits(spark, sf)).select("oid", "a", "q"))


_group_query("atiras", filters.atiras, IS_ATIRA)
_group_query("atens", filters.atens, IS_ATEN)
_group_query("apollos", filters.apollos, IS_APOLLO)
_group_query("amors", filters.amors, IS_AMOR)


@query("group_tags", sql("SELECT oid, grp FROM tagged", f"tagged AS ({TAGS.format(src='orbits')})"))
def group_tags(spark, sf):
    return filters.group_tags(orbits(spark, sf)).select("oid", "grp")


def _label_query(name, fn, case):
    @query(
        name,
        sql(f"SELECT oid, CAST({case} AS INTEGER) AS label FROM orbits WHERE ({case}) IS NOT NULL"),
    )
    def run(spark, sf):
        return fn(orbits(spark, sf)).select("oid", "label")


_label_query("haz_by_flag", filters.haz_by_flag, LABEL_FLAG)
_label_query("haz_by_h", filters.haz_by_h, "CASE WHEN h < 22e0 THEN 1 WHEN h >= 22e0 THEN 0 END")
_label_query("haz_by_moid", filters.haz_by_moid, LABEL_MOID)


@query("cutoff_outliers", sql(f"SELECT oid, {r6(a='a', i='i')} FROM orbits WHERE a < 5e0 AND i < 100e0"))
def cutoff_outliers(spark, sf):
    return rounded(filters.cutoff_outliers(orbits(spark, sf)).select("oid", "a", "i"))


@query(
    "split_by_colval",
    sql(f"SELECT oid, CASE WHEN q <= 0.7e0 THEN 'left' ELSE 'right' END AS side, {r6(q='q')} FROM orbits"),
)
def split_by_colval(spark, sf):
    return rounded(filters.split_by_colval(orbits(spark, sf), "q", 0.7).select("oid", "side", "q"))


_SIDE = "CASE WHEN -(0.95e0-0.15e0)*(a-0.545e0) + (0.945e0-0.545e0)*(q-0.15e0) <= 0 THEN 'left' ELSE 'right' END"


@query("split_by_line", sql(f"SELECT oid, label, {_SIDE} AS side FROM lab", LABELLED))
def split_by_line(spark, sf):
    df = filters.split_by_line(labelled_orbits(spark, sf), (0.545, 0.15), (0.945, 0.95), "a", "q")
    return df.select("oid", "label", "side")


@query(
    "split_by_line_purity",
    sql(
        f"SELECT side, CAST(SUM(label) AS BIGINT) AS n_pha, CAST(SUM(1-label) AS BIGINT) AS n_nha, {r6(purity='AVG(label)')} FROM s GROUP BY side",
        LABELLED,
        f"s AS (SELECT label, {_SIDE} AS side FROM lab)",
    ),
)
def split_by_line_purity(spark, sf):
    df = filters.split_by_line(labelled_orbits(spark, sf), (0.545, 0.15), (0.945, 0.95), "a", "q")
    return rounded(filters.side_purity(df))


@query(
    "project", sql(f"SELECT CAST(label AS INTEGER) AS label, {r6(w='w', q='q', i='i')} FROM lab", LABELLED)
)
def project(spark, sf):
    return rounded(filters.project(labelled_orbits(spark, sf), ["w", "q", "i"]))


@query(
    "box_filter",
    sql(f"SELECT oid, {r6(w='w', q='q')} FROM orbits WHERE w BETWEEN 30e0 AND 200e0 AND q BETWEEN 0.5e0 AND 1.0e0"),
)
def box_filter(spark, sf):
    box = {"w": (30.0, 200.0), "q": (0.5, 1.0)}
    return rounded(filters.box_filter(orbits(spark, sf), box).select("oid", "w", "q"))


_LEVELS = [100.0, 150.0, 200.0, 300.0]
_MINI = "CASE WHEN w > 0.1e0 AND w <= 150e0*1.001e0 THEN 0 WHEN w > 150e0*0.001e0 AND w <= 200e0*1.001e0 THEN 1 WHEN w > 200e0*0.001e0 AND w <= 300e0*1.001e0 THEN 2 END"


@query(
    "minigroups",
    sql(f"SELECT oid, CAST({_MINI} AS INTEGER) AS minigroup FROM orbits WHERE ({_MINI}) IS NOT NULL"),
)
def minigroups(spark, sf):
    return filters.minigroups(orbits(spark, sf), "w", _LEVELS).select("oid", "minigroup")


@query(
    "domain_split",
    sql(
        "SELECT oid, CAST(domain AS INTEGER) AS domain, CASE WHEN domain = 2 THEN 1 ELSE 0 END AS in_domain_2 FROM d2",
        f"d2 AS (SELECT oid, {_DOMAIN_SQL} AS domain FROM orbits)",
    ),
)
def domain_split(spark, sf):
    df = filters.domain_split(orbits(spark, sf), _domains())
    return df.select("oid", "domain", filters.in_domain(2).alias("in_domain_2"))


# --- bounds and scaling ----------------------------------------------------------------------

_BY_ORIGIN = lambda df: [df.filter(F.col("origin") == o) for o in ("gen", "real")]


@query(
    "common_bounds",
    sql("SELECT " + ", ".join(r6(**{f"{c}_min": f"MIN({c})", f"{c}_max": f"MAX({c})"}) for c in ("w", "q", "i")) + " FROM orbits"),
)
def common_bounds(spark, sf):
    return rounded(scaling.common_bounds(_BY_ORIGIN(orbits(spark, sf)), ["w", "q", "i"]))


def _long_bounds(src, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {r6(lo=f'MIN({c})', hi=f'MAX({c})')} FROM {src}" for c in cols)


@query("df_common_bounds", sql(_long_bounds("orbits", ("a", "e", "om"))))
def df_common_bounds(spark, sf):
    return rounded(scaling.df_common_bounds(_BY_ORIGIN(orbits(spark, sf)), ["a", "e", "om"]))


@query(
    "common_scales",
    sql(
        f"SELECT col, {r6(lo='MIN(lo)', hi='MAX(hi)')} FROM parts GROUP BY col",
        "parts AS (" + _long_bounds("(SELECT * FROM orbits WHERE origin = 'gen')", ("q", "i"))
        + " UNION ALL " + _long_bounds("(SELECT * FROM orbits WHERE origin = 'real')", ("q", "i")) + ")",
    ),
)
def common_scales(spark, sf):
    parts = [scaling.df_common_bounds([d], ["q", "i"]) for d in _BY_ORIGIN(orbits(spark, sf))]
    return rounded(scaling.common_scales(parts))


@query(
    "param_bounds",
    sql("SELECT " + ", ".join(r6(**{f"{c}_min": f"MIN({c})", f"{c}_max": f"MAX({c})"}) for c in ("a", "i", "w", "om", "q")) + " FROM orbits"),
)
def param_bounds(spark, sf):
    return rounded(scaling.param_bounds(orbits(spark, sf), ["a", "i", "w", "om", "q"]))


def _unit_sql(*cols):
    return r6(**{c: f"({c} - b2.{c}_min)/(b2.{c}_max - b2.{c}_min)" for c in cols})


def _bounds_cte(name, src, *cols):
    return f"{name} AS (SELECT " + ", ".join(f"MIN({c}) AS {c}_min, MAX({c}) AS {c}_max" for c in cols) + f" FROM {src})"


@query(
    "minmax_normalize",
    sql(f"SELECT oid, {_unit_sql('a', 'i')} FROM orbits, b2", _bounds_cte("b2", "orbits", "a", "i")),
)
def minmax_normalize(spark, sf):
    return rounded(scaling.minmax_normalize(orbits(spark, sf), ["a", "i"])[0].select("oid", "a", "i"))


_DM_VALUES = "CASE WHEN w <= 180e0 THEN [w, 180e0-w, 360e0-w, 180e0+w] ELSE [w, 540e0-w, 360e0-w, w-180e0] END"


@query(
    "cut_normalize",
    sql(
        f"SELECT dataset, CAST(label AS INTEGER) AS label, {_unit_sql('w', 'q')} FROM parts, b2",
        LABELLED,
        "parts AS (SELECT 'gen' AS dataset, label, w, q FROM lab WHERE origin = 'gen' UNION ALL "
        "SELECT 'real', label, w, q FROM lab WHERE origin = 'real' UNION ALL "
        f"SELECT 'mirrored', label, UNNEST({_DM_VALUES}), q FROM lab WHERE origin = 'gen')",
        _bounds_cte("b2", "parts", "w", "q"),
    ),
)
def cut_normalize(spark, sf):
    gen, real = _BY_ORIGIN(labelled_orbits(spark, sf))
    sets = {"gen": gen, "real": real, "mirrored": augment.double_mirror(gen, "w", 180.0)}
    return rounded(scaling.cut_normalize(["w", "q"], sets)[0])


@query("rescale", sql(f"SELECT oid, {r6(a='a', i='i')} FROM orbits"))
def rescale(spark, sf):
    scaled, scales = scaling.minmax_normalize(orbits(spark, sf), ["a", "i"])
    return rounded(scaling.rescale(scaled, scales).select("oid", "a", "i"))


# --- reports ---------------------------------------------------------------------------------


@query(
    "group_weight",
    sql(
        f"SELECT origin, grp, CAST(SUM(label) AS BIGINT) AS n_pha, CAST(SUM(1-label) AS BIGINT) AS n_nha, CAST(COUNT(*) AS BIGINT) AS n, {r6(weight='COUNT(*)*1e0/MIN(t.total)', purity='AVG(label)')} FROM tagged JOIN t USING (origin) GROUP BY origin, grp",
        LABELLED,
        f"tagged AS ({TAGS.format(src='lab')})",
        "t AS (SELECT origin, COUNT(*) AS total FROM lab GROUP BY origin)",
    ),
)
def group_weight(spark, sf):
    return rounded(quality.group_weight(labelled_orbits(spark, sf)))


@query(
    "split_quality",
    sql(
        "SELECT origin, CAST(tp AS BIGINT) AS pha_in, CAST(fp AS BIGINT) AS nha_in, CAST(fn AS BIGINT) AS pha_out, CAST(tn AS BIGINT) AS nha_out, "
        + r6(pha_purity="tp*1e0/NULLIF(tp+fp,0)", nha_purity="tn*1e0/NULLIF(tn+fn,0)", recall="tp*1e0/NULLIF(tp+fn,0)")
        + " FROM c2",
        LABELLED,
        f"p AS (SELECT origin, label, {RULE_SQL} AS pr FROM lab)",
        "c2 AS (SELECT origin, SUM(label*pr) AS tp, SUM((1-label)*pr) AS fp, SUM(label*(1-pr)) AS fn, SUM((1-label)*(1-pr)) AS tn FROM p GROUP BY origin)",
    ),
)
def split_quality(spark, sf):
    df = labelled_orbits(spark, sf).withColumn("prediction", rule_prediction())
    return rounded(quality.split_quality(df, ["origin"]))


_SUMMARY_COLS = (
    "CAST(SUM(label*pr) AS BIGINT) AS extracted_pha, CAST(SUM((1-label)*pr) AS BIGINT) AS trapped_nha, "
    + r6(
        pha_fraction="SUM(label*pr)*1e0/NULLIF(MIN(np),0)",
        nha_fraction="SUM((1-label)*pr)*1e0/NULLIF(MIN(nn),0)",
        purity="SUM(label*pr)*1e0/NULLIF(SUM(pr),0)",
    )
)


def _summary_level(keys, level):
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    src = "tagged" if "grp" in keys else "p"
    cols = ", ".join(f"x.{k}" if k in keys else f"NULL AS {k}" for k in ("origin", "domain", "grp"))
    names = ", ".join(keys)
    return (
        f"SELECT {cols}, CAST({level} AS INTEGER) AS level, {_SUMMARY_COLS} FROM tagged x JOIN "
        f"(SELECT {names}, SUM(label) AS np, SUM(1-label) AS nn FROM {src} GROUP BY {names}) y ON {on} "
        f"GROUP BY {', '.join('x.' + k for k in keys)}"
    )


@query(
    "summary",
    sql(
        f"SELECT origin, CAST(domain AS INTEGER) AS domain, CAST(grp AS VARCHAR) AS grp, level, extracted_pha, trapped_nha, pha_fraction, nha_fraction, purity FROM ("
        + " UNION ALL ".join(
            [_summary_level(["origin", "domain", "grp"], 0), _summary_level(["origin", "domain"], 1), _summary_level(["origin"], 3)]
        ).replace(_SUMMARY_COLS, _SUMMARY_COLS.replace("label", "x.label").replace("pr)", "x.pr)"))
        + ")",
        LABELLED,
        f"p AS (SELECT *, {_DOMAIN_SQL} AS domain, {RULE_SQL} AS pr FROM lab)",
        f"tagged AS ({TAGS.format(src='p')})",
    ),
)
def summary(spark, sf):
    df = filters.domain_split(labelled_orbits(spark, sf), _domains())
    tagged = quality.tagged_for_summary(df)
    # Orbits of no group are in no region.
    tagged = tagged.withColumn("extracted", F.col("grp").isNotNull() & (rule_prediction() == 1))
    return rounded(quality.summary(tagged))


def _cluster_sql(w="w"):
    return f"CAST(CASE WHEN {w} < 90e0 THEN 1 WHEN {w} < 240e0 THEN 2 WHEN {w} < 300e0 THEN 3 ELSE 4 END AS INTEGER)"


def rule_clusters(df):
    """Fixed clusters in place of found ones."""
    w = F.col("w")
    return df.withColumn("cluster_id", F.when(w < 90, 1).when(w < 240, 2).when(w < 300, 3).otherwise(4))


@query(
    "cluster_haz_fraction",
    sql(
        f"SELECT {_cluster_sql()} AS cluster_id, CAST(COUNT(*) AS BIGINT) AS n, {r6(haz_fraction='AVG(label)')} FROM lab GROUP BY 1",
        LABELLED,
    ),
)
def cluster_haz_fraction(spark, sf):
    return rounded(quality.cluster_haz_fraction(rule_clusters(labelled_orbits(spark, sf))))


@query(
    "prediction_score",
    sql(
        "SELECT " + r6(
            score="AVG(CASE WHEN pr = label THEN 1e0 ELSE 0e0 END)",
            predicted_haz_fraction="AVG(pr)",
            true_haz_fraction="AVG(label)",
        ) + " FROM p",
        LABELLED,
        f"p AS (SELECT label, {RULE_SQL} AS pr FROM lab)",
    ),
)
def prediction_score(spark, sf):
    df = labelled_orbits(spark, sf).withColumn("prediction", rule_prediction())
    return rounded(quality.prediction_score(df))


def _hist_sql(src, col, n, name=None):
    named = f"'{name}' AS name, " if name else ""
    return (
        f"SELECT {named}CAST(g.k AS INTEGER) AS bin, "
        + r6(center="(g.k+0.5e0)*p.width", width="p.width", density="COALESCE(c.n,0)/(p.total*p.width)")
        + f" FROM (SELECT hi/nb AS width, nb, total FROM (SELECT MAX({col}) AS hi, "
        f"CAST(FLOOR(MAX({col})*{n}/(MAX({col})-MIN({col}))) AS BIGINT)-1 AS nb, COUNT(CASE WHEN {col} >= 0 THEN 1 END) AS total FROM {src})) p "
        f"JOIN (SELECT UNNEST(RANGE(0, 100000)) AS k) g ON g.k < p.nb LEFT JOIN "
        f"(SELECT CAST(LEAST(FLOOR({col}/(hi/nb)), nb-1) AS BIGINT) AS k, COUNT(*) AS n FROM {src}, "
        f"(SELECT MAX({col}) AS hi, CAST(FLOOR(MAX({col})*{n}/(MAX({col})-MIN({col}))) AS BIGINT)-1 AS nb FROM {src}) "
        f"WHERE {col} >= 0 GROUP BY 1) c ON c.k = g.k"
    )


@query("hist_density", sql(_hist_sql("orbits", "q", 25)))
def hist_density(spark, sf):
    return rounded(histogram.hist_density(orbits(spark, sf), "q", 25))


@query("hist_density_events", _hist_sql("ev", "value", 50).join(["WITH ev AS (SELECT CAST(value AS DOUBLE) AS value FROM events) ", ""]))
def hist_density_events(spark, sf):
    values = spark.read.parquet(f"{sf}/events.parquet").select(F.col("value").cast("double").alias("value"))
    return rounded(histogram.hist_density(values, "value", 50))


_PAIRS = [(x, y) for k, x in enumerate(("a", "i", "w", "e", "q", "om")) for y in ("a", "i", "w", "e", "q", "om")[k + 1:]]


def _slot(c):
    return f"CAST(LEAST(FLOOR(({c}-{c}_min)/({c}_max-{c}_min)*50), 49) AS INTEGER)"


@query(
    "pair_distribution",
    sql(
        "SELECT pair, CAST(label AS INTEGER) AS label, xbin, ybin, CAST(COUNT(*) AS BIGINT) AS n FROM u GROUP BY ALL",
        LABELLED,
        _bounds_cte("b2", "lab", "a", "i", "w", "e", "q", "om"),
        "s AS (SELECT label, " + ", ".join(f"{_slot(c)} AS s_{c}" for c in ("a", "i", "w", "e", "q", "om")) + " FROM lab, b2)",
        "u AS (" + " UNION ALL ".join(f"SELECT '{x}-{y}' AS pair, label, s_{x} AS xbin, s_{y} AS ybin FROM s" for x, y in _PAIRS) + ")",
    ),
)
def pair_distribution(spark, sf):
    return histogram.pair_distribution(labelled_orbits(spark, sf))


# --- unions and copies -----------------------------------------------------------------------


@query(
    "union_groups",
    sql(f"SELECT oid, {r6(a='a', q='q')} FROM orbits WHERE {IS_ATIRA} UNION ALL SELECT oid, {r6(a='a', q='q')} FROM orbits WHERE {IS_ATEN}"),
)
def union_groups(spark, sf):
    return rounded(augment.union_groups(orbits(spark, sf)).select("oid", "a", "q"))


def _copies_query(name, fn, values, src="orbits", ctes=()):
    @query(name, sql(f"SELECT oid, {r6(w='w')} FROM (SELECT oid, UNNEST({values}) AS w FROM {src})", *ctes))
    def run(spark, sf):
        return rounded(fn(orbits(spark, sf).select("oid", "w")))


_copies_query("mirror", lambda d: augment.mirror(d, "w", 180.0), "[w, 360e0-w]")
_copies_query("double_mirror", lambda d: augment.double_mirror(d, "w", 180.0), _DM_VALUES)
_copies_query(
    "shift_mirror",
    lambda d: augment.shift_mirror(d, "w", 180.0),
    "[w, CASE WHEN w <= 180e0 THEN w+180e0 ELSE w-180e0 END, 360e0-w]",
)
_copies_query(
    "extend_copies",
    lambda d: augment.extend_copies(d, "w", 0.25),
    "LIST_FILTER([w, CASE WHEN w < (b2.w_max-b2.w_min)*0.25e0 THEN w+(b2.w_max-b2.w_min) END, "
    "CASE WHEN w > b2.w_max-(b2.w_max-b2.w_min)*0.25e0 THEN w-(b2.w_max-b2.w_min) END], lambda v: v IS NOT NULL)",
    "orbits, b2",
    (_bounds_cte("b2", "orbits", "w"),),
)


@query(
    "cluster_mirror",
    sql(
        f"SELECT oid, {_cluster_sql('w0')} AS cluster_id, {r6(w='w')} FROM (SELECT oid, w AS w0, UNNEST({_DM_VALUES.replace('<=', '<')}) AS w FROM orbits)"
    ),
)
def cluster_mirror(spark, sf):
    df = rule_clusters(orbits(spark, sf)).select("oid", "cluster_id", "w")
    return rounded(augment.cluster_mirror(df, "w", 180.0))


@query(
    "labelled_mix", sql(f"SELECT CAST(label AS INTEGER) AS label, {r6(w='w', q='q')} FROM lab", LABELLED)
)
def labelled_mix(spark, sf):
    return rounded(augment.labelled_mix(labelled_orbits(spark, sf), ["w", "q"], seed=1))


# --- orbit geometry --------------------------------------------------------------------------


def _column_query(name, oracle_cols: dict, columns):
    """``columns`` builds the Columns, once a session exists."""

    @query(name, sql(f"SELECT oid, {r6(**oracle_cols)} FROM orbits"))
    def run(spark, sf):
        return rounded(orbits(spark, sf).select("oid", *[c.alias(n) for n, c in columns().items()]))


_column_query("eccentricity", {"e": "(a-q)/a"}, lambda: {"e": O.eccentricity()})
_column_query(
    "semimajor",
    {"a": "q/(1e0-CASE WHEN e >= 1e0 THEN 0.99e0 ELSE e END)"},
    lambda: {"a": O.semimajor()},
)
_column_query(
    "period",
    {"per": "2*PI()*SQRT(POW(a*149597870700e0, 3)/(6.67384e-11*1.989e30))/86400e0"},
    lambda: {"per": O.period()},
)
_column_query("aphelion", {"big_q": "2*a-q"}, lambda: {"big_q": O.aphelion()})
_column_query(
    "orbit_radius",
    {"r": "a*(1e0-e*e)/(1e0+e*COS(RADIANS(om)))"},
    lambda: {"r": O.orbit_radius(F.radians("om"))},
)


def _xyz(t, a="a", e="e", i="i", w="w", om="om"):
    r = f"({a}*(1e0-{e}*{e})/(1e0+{e}*COS({t})))"
    u, n, k = f"({t}+RADIANS({w}))", f"RADIANS({om})", f"RADIANS({i})"
    return {
        "x": f"{r}*(COS({n})*COS({u})-SIN({n})*SIN({u})*COS({k}))",
        "y": f"{r}*(SIN({n})*COS({u})+COS({n})*SIN({u})*COS({k}))",
        "z": f"{r}*SIN({u})*SIN({k})",
    }


def _point_query(name, fn):
    @query(name, sql(f"SELECT oid, {r6(**_xyz('RADIANS(h*10)'))} FROM orbits"))
    def run(spark, sf):
        p = fn(F.radians(F.col("h") * 10))
        return rounded(orbits(spark, sf).select("oid", p.alias("p")).select("oid", "p.x", "p.y", "p.z"))


_point_query("orbit_point", O.orbit_point)
_point_query("orbit_point_rotation", O.orbit_point_rotation)

# Earth's point at the anomaly each orbit's node gives.
_earth_xyz = _xyz("RADIANS(om)", "1.00000261e0", "0.01671123e0", "0e0", "114.20783e0", "348.73936e0")


@query("earth_point", sql(f"SELECT oid, {r6(**_earth_xyz)} FROM orbits"))
def earth_point(spark, sf):
    p = O.earth_point(F.radians("om")).alias("p")
    return rounded(orbits(spark, sf).select("oid", p).select("oid", "p.x", "p.y", "p.z"))


_column_query(
    "node_distance",
    {"rasc": "a*(1e0-e*e)/(1e0+e*COS(RADIANS(w)))"},
    lambda: {"rasc": O.node_distance()},
)
_column_query(
    "orbit_center",
    {
        "cx": "-a*e*(COS(RADIANS(om))*COS(RADIANS(w))-SIN(RADIANS(om))*SIN(RADIANS(w))*COS(RADIANS(i)))",
        "cy": "-a*e*(SIN(RADIANS(om))*COS(RADIANS(w))+COS(RADIANS(om))*SIN(RADIANS(w))*COS(RADIANS(i)))",
        "cz": "-a*e*SIN(RADIANS(w))*SIN(RADIANS(i))",
    },
    lambda: {f"c{k}": O.orbit_center()[k] for k in "xyz"},
)

_BOX = {f"{f}_{c}": f"{f.upper()}({c})" for c in "xyz" for f in ("min", "max")}


def _box_of(points, *cols):
    aggs = [getattr(F, f)(c).alias(f"{f}_{c}") for c in cols for f in ("min", "max")]
    return rounded(points.groupBy("oid").agg(F.count("*").alias("n"), *aggs))


_POLY = (
    "g AS (SELECT o.*, k, CASE WHEN k <= 50 THEN PI()*SIN(k*(PI()/100)) ELSE 2*PI()-PI()*SIN(k*(PI()/100)) END AS t "
    "FROM orbits o, (SELECT UNNEST(RANGE(0, 101)) AS k))",
    "pts AS (SELECT oid, k, " + ", ".join(f"{e} AS {n}" for n, e in _xyz("t").items()) + " FROM g)",
)


@query("orbit_polyline", sql(f"SELECT oid, CAST(COUNT(*) AS BIGINT) AS n, {r6(**_BOX)} FROM pts GROUP BY oid", *_POLY))
def orbit_polyline(spark, sf):
    return _box_of(geometry.orbit_polyline(orbits(spark, sf)), "x", "y", "z")


@query(
    "ellipse_polyline",
    sql(
        f"SELECT oid, CAST(COUNT(*) AS BIGINT) AS n, {r6(**{k: v for k, v in _BOX.items() if 'z' not in k})} FROM pts GROUP BY oid",
        "g AS (SELECT o.*, RADIANS(k*(360e0/49)) AS t FROM orbits o, (SELECT UNNEST(RANGE(0, 50)) AS k))",
        "pts AS (SELECT oid, a*COS(t)+a*e AS x, a*SQRT(1e0-e*e)*SIN(t) AS y FROM g)",
    ),
)
def ellipse_polyline(spark, sf):
    return _box_of(geometry.ellipse_polyline(orbits(spark, sf)), "x", "y")


_FEW = 8  # points of an orbit in the queries that return them


@query(
    "orbit_points",
    sql(f"SELECT oid, CAST(k AS INTEGER) AS k, {r6(theta='t', x='x', y='y', z='z')} FROM pts", *[c.replace("101", str(_FEW + 1)).replace("100", str(_FEW)).replace("k <= 50", f"k <= {_FEW // 2}").replace("SELECT oid, k, ", "SELECT oid, k, t, ") for c in _POLY]),
)
def orbit_points(spark, sf):
    return rounded(geometry.orbit_polyline(orbits(spark, sf), _FEW))


@query(
    "ecliptic_closest",
    sql(
        f"SELECT oid, {r6(rx='MIN(gap)', ry='ARG_MIN(z, gap)')} FROM gaps GROUP BY oid",
        *_POLY,
        "gaps AS (SELECT oid, z, ABS(SQRT(x*x+y*y)-1) AS gap FROM pts)",
    ),
)
def ecliptic_closest(spark, sf):
    return rounded(geometry.ecliptic_closest(orbits(spark, sf)))


# --- distance to the orbit of the Earth ------------------------------------------------------

_TURN = "RADIANS(114.20783e0+348.73936e0)"
_EARTH_R = f"(1.00000261e0*(1e0-0.01671123e0*0.01671123e0)/(1e0+0.01671123e0*COS(ATAN2(y,x)-{_TURN})))"


@query(
    "moid_coarse",
    sql(
        f"SELECT oid, {r6(moid_coarse='LEAST(SQRT(MIN(d2)), 5.45492e0)', theta='ARG_MIN(t, d2)')} FROM dd GROUP BY oid",
        "g AS (SELECT o.*, k*(2*PI()/72) AS t FROM orbits o, (SELECT UNNEST(RANGE(0, 72)) AS k))",
        "pts AS (SELECT oid, t, " + ", ".join(f"{e} AS {n}" for n, e in _xyz("t").items()) + " FROM g)",
        f"dd AS (SELECT oid, t, POW(SQRT(x*x+y*y)-{_EARTH_R}, 2) + z*z AS d2 FROM pts)",
    ),
)
def moid_coarse(spark, sf):
    return rounded(moid.moid_coarse(orbits(spark, sf)))


# Check of the full distance by another method: the exact nearest point of the Earth's ellipse for
# each eccentric anomaly (a contraction, five rounds), local minima on a ring of 360, then 16 zooms.
_E_B = "(1.00000261e0*SQRT(1e0-0.01671123e0*0.01671123e0))"
_E_GAP = "(1.00000261e0*1.00000261e0*0.01671123e0*0.01671123e0)"


def _nearest_sql(src: str) -> str:
    """Rows of ``src`` (oid, cid, ea) with f = squared distance to the Earth's orbit."""
    xyz = ", ".join(f"p{k}*COS(ea)+q{k}*SIN(ea)+c{k} AS v{k}" for k in "xyz")
    turn = (
        f"SELECT oid, cid, ea, vx*COS({_TURN})+vy*SIN({_TURN})+1.00000261e0*0.01671123e0 AS gx, "
        f"vy*COS({_TURN})-vx*SIN({_TURN}) AS gy, vz AS gz FROM (SELECT oid, cid, ea, {xyz} FROM {src} JOIN vec USING (oid))"
    )
    step = f"SELECT *, ATAN2(gy, gx) AS f0 FROM ({turn})"
    for k in range(5):
        step = f"SELECT * EXCLUDE (f{k}), ATAN2({_E_B}*gy, 1.00000261e0*gx-{_E_GAP}*COS(f{k})) AS f{k+1} FROM ({step})"
    return (
        f"SELECT oid, cid, ea, POW(gx-1.00000261e0*COS(f5),2)+POW(gy-{_E_B}*SIN(f5),2)+gz*gz AS f FROM ({step})"
    )


_PV = {
    "x": "(COS(RADIANS(om))*COS(RADIANS(w))-SIN(RADIANS(om))*SIN(RADIANS(w))*COS(RADIANS(i)))",
    "y": "(SIN(RADIANS(om))*COS(RADIANS(w))+COS(RADIANS(om))*SIN(RADIANS(w))*COS(RADIANS(i)))",
    "z": "(SIN(RADIANS(w))*SIN(RADIANS(i)))",
}
_QV = {
    "x": "(-COS(RADIANS(om))*SIN(RADIANS(w))-SIN(RADIANS(om))*COS(RADIANS(w))*COS(RADIANS(i)))",
    "y": "(-SIN(RADIANS(om))*SIN(RADIANS(w))+COS(RADIANS(om))*COS(RADIANS(w))*COS(RADIANS(i)))",
    "z": "(COS(RADIANS(w))*SIN(RADIANS(i)))",
}
_MOID_CTES = [
    "vec AS (SELECT oid, " + ", ".join(
        f"a*{_PV[k]} AS p{k}, a*SQRT(1e0-e*e)*{_QV[k]} AS q{k}, -a*e*{_PV[k]} AS c{k}" for k in "xyz"
    ) + " FROM orbits)",
    "ring AS (SELECT oid, k AS cid, k*(2*PI()/360) AS ea FROM orbits, (SELECT UNNEST(RANGE(0, 360)) AS k))",
    f"prof AS ({_nearest_sql('ring')})",
    "ends AS (SELECT *, LAG(f) OVER o AS fl, LEAD(f) OVER o AS fr, FIRST_VALUE(f) OVER o AS f_first, "
    "LAST_VALUE(f) OVER (PARTITION BY oid ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f_last "
    "FROM prof WINDOW o AS (PARTITION BY oid ORDER BY cid))",
    "z0 AS (SELECT oid, cid, ea FROM ends WHERE f <= COALESCE(fl, f_last) AND f <= COALESCE(fr, f_first))",
]
for _k in range(16):
    _h = 0.0175 * 0.35**_k
    _MOID_CTES.append(
        f"y{_k} AS (SELECT oid, cid, ea + j*{_h:.18f}e0/4 AS ea FROM z{_k}, (SELECT UNNEST(RANGE(-4, 5)) AS j))"
    )
    _MOID_CTES.append(
        f"z{_k+1} AS (SELECT oid, cid, ARG_MIN(ea, f) AS ea, MIN(f) AS f FROM ({_nearest_sql(f'y{_k}')}) GROUP BY oid, cid)"
    )


@query(
    "moid",
    sql(f"SELECT oid, {r6(moid='LEAST(SQRT(MIN(f)), 5.45492e0)')} FROM z16 GROUP BY oid", *_MOID_CTES),
)
def moid_query(spark, sf):
    return rounded(orbits(spark, sf).select("oid", moid.moid().alias("moid")))
