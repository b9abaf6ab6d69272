"""The registered queries of the profiler, each with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.functions import complexity, recognizers, redaction
from pathlode.operators import anomalies, compare, drift, essence, fingerprints, governance, profile, relations, separation, sketches, temporal
from pathlode.plans import query
from pathlode.sources import records
from pathlode.sources.documents import json_nodes
from pathlode.sources.tables import table_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed scale; sums of floats differ in their last bits with the order of rows."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def sql_rows(table: str, columns: tuple[str, ...]) -> str:
    """SQL for (path, value, num) rows of some columns."""
    return " UNION ALL ".join(f"SELECT '$[*].{c}' AS path, coalesce(CAST({c} AS VARCHAR), 'null') AS value FROM {table}" for c in columns)


def sql_numbers(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '$[*].{c}' AS path, CAST({c} AS DOUBLE) AS num FROM {table} WHERE {c} IS NOT NULL" for c in columns)


EVENT_TYPES = {"event_id": "integer", "ts": "string", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"}


@register(
    "SELECT '$[*]' AS path, count(*) AS count, 1 AS depth, 'object' AS dominant_type, 0.0::DOUBLE AS type_instability, 0.0::DOUBLE AS null_rate FROM events"
    + "".join(
        f" UNION ALL SELECT '$[*].{c}', count(*), 2, CASE WHEN count({c}) * 2 >= count(*) THEN '{t}' ELSE 'null' END,"
        f" round(1 - greatest(count({c}), count(*) - count({c})) / count(*), 6), round((count(*) - count({c})) / count(*), 6) FROM events"
        for c, t in EVENT_TYPES.items()
    )
)
def path_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.path_inventory(table_nodes(read(spark, sf_dir, "events"))).select("path", "count", "depth", "dominant_type", "type_instability", "null_rate"))


@register("SELECT (SELECT count(*) * 7 + 1 FROM events) AS total_nodes, 2 AS max_depth, 8::BIGINT AS distinct_paths")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.document_metadata(table_nodes(read(spark, sf_dir, "events"))).select("total_nodes", "max_depth", "distinct_paths")


ORDER_TEXT = ("o_orderstatus", "o_orderpriority")


@register(f"SELECT path, value, count(*) AS count FROM ({sql_rows('orders', ORDER_TEXT)}) GROUP BY ALL")
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_frequency(table_nodes(read(spark, sf_dir, "orders"), list(ORDER_TEXT)))


@register(
    f"SELECT path, value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY count DESC, value) AS rank FROM "
    f"(SELECT path, value, count(*) AS count FROM ({sql_rows('events', ('event_type', 'user_id'))}) GROUP BY ALL)) WHERE rank <= 10"
)
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.top_values(profile.value_frequency(table_nodes(read(spark, sf_dir, "events"), ["event_type", "user_id"])))
    return found.select("path", "value", "count", long("rank"))


EVENT_COLUMNS = ("event_type", "user_id", "value")
_COUNTS = f"(SELECT path, value, count(*) AS c FROM ({sql_rows('events', EVENT_COLUMNS)}) GROUP BY ALL)"
_SHARES = f"(SELECT path, value, c, sum(c) OVER (PARTITION BY path) AS n, c / sum(c) OVER (PARTITION BY path) AS p FROM {_COUNTS})"


@register(
    f"""SELECT path, sum(c)::BIGINT AS total_count, count(*) AS cardinality, round(greatest(0, -sum(p * log2(p))), 6) + 0.0 AS entropy,
        round(CASE WHEN count(*) > 1 THEN least(1.0, -sum(p * log2(p)) / log2(count(*))) ELSE 0.0 END, 6) + 0.0 AS normalized_entropy,
        round(-log2(min(p)), 6) + 0.0 AS max_rarity FROM {_SHARES} GROUP BY path"""
)
def path_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.value_statistics(profile.value_frequency(table_nodes(read(spark, sf_dir, "events"), list(EVENT_COLUMNS)))))


@register(
    f"""WITH h AS (SELECT path, log2(count(*)) AS h0, -sum(p * log2(p)) AS h1, -log2(sum(p * p)) AS h2, -log2(max(p)) AS h_inf FROM {_SHARES} GROUP BY path)
        SELECT path, round(h0, 6) + 0.0 AS h0, round(h1, 6) + 0.0 AS h1, round(h2, 6) + 0.0 AS h2, round(h_inf, 6) + 0.0 AS h_inf, round(h0 - h_inf, 6) + 0.0 AS divergence,
        round(h1 / h0, 6) + 0.0 AS h1_normalized, round(h2 / h0, 6) + 0.0 AS h2_normalized, round(h_inf / h0, 6) + 0.0 AS h_inf_normalized FROM h"""
)
def renyi_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.renyi_spectrum(profile.value_frequency(table_nodes(read(spark, sf_dir, "events"), list(EVENT_COLUMNS)))))


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(
    f"""SELECT path, count(*) AS count, round(min(num), 6) AS min, round(max(num), 6) AS max, round(avg(num), 6) AS mean, round(median(num), 6) AS median,
        round(mad(num), 6) AS mad, round(quantile_cont(num, 0.05), 6) AS p05, round(quantile_cont(num, 0.25), 6) AS p25,
        round(quantile_cont(num, 0.75), 6) AS p75, round(quantile_cont(num, 0.95), 6) AS p95 FROM ({sql_numbers('lineitem', LINE_NUMBERS)}) GROUP BY path"""
)
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.numeric_summary(table_nodes(read(spark, sf_dir, "lineitem"), list(LINE_NUMBERS))))


_DIGITS = "SELECT path, least(9, greatest(1, floor(abs(num) / pow(10.0, floor(log10(abs(num)))))))::INT AS d FROM ({rows}) WHERE num <> 0"


@register(
    f"""WITH x AS ({_DIGITS.format(rows=sql_numbers('lineitem', ('l_extendedprice', 'l_quantity')))}),
        w AS (SELECT path, count(*) AS n, {', '.join(f'count(*) FILTER (d = {d}) AS d{d}' for d in range(1, 10))} FROM x GROUP BY path)
        SELECT path, n AS count, {', '.join(f'd{d}' for d in range(1, 10))},
        round({' + '.join(f'pow(d{d} - n * log10({1 + 1 / d!r}), 2) / (n * log10({1 + 1 / d!r}))' for d in range(1, 10))}, 6) AS chi_squared,
        round(({' + '.join(f'abs(d{d} / n - log10({1 + 1 / d!r}))' for d in range(1, 10))}) / 9, 6) AS mad,
        ({' + '.join(f'abs(d{d} / n - log10({1 + 1 / d!r}))' for d in range(1, 10))}) / 9 < 0.015 AS conforms FROM w"""
)
def benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.benford(table_nodes(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])))


@register(
    """WITH c AS (SELECT median(value) AS m, mad(value) AS d FROM events),
       z AS (SELECT event_id AS record_id, value, 0.6745 * (value - m) / d AS z, m, d FROM events, c)
       SELECT '$[*].value' AS path, record_id, round(value, 6) AS value, round(z, 6) AS z_mad, round(m, 6) AS median, round(d, 6) AS mad FROM z WHERE abs(z) > 3.5"""
)
def numeric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomalies.numeric_outliers(table_nodes(read(spark, sf_dir, "events"), ["value"], F.col("event_id"))))


@register(
    """WITH k AS (SELECT CASE WHEN p_partkey % 100 = 0 THEN 'rare ' || (p_partkey % 7) ELSE p_brand END AS v FROM part),
       c AS (SELECT v, count(*) AS n FROM k GROUP BY v), b AS (SELECT v, n, log2((SELECT sum(n) FROM c)) - log2(n) AS bits FROM c),
       m AS (SELECT avg(bits) AS mean FROM b), d AS (SELECT median(abs(bits - mean)) AS mad FROM b, m)
       SELECT '$[*].kind' AS path, v AS value, n AS count, round(bits, 6) AS rarity_bits FROM b, m, d WHERE mad > 2.3e-16 AND bits > mean + 2.0 * mad"""
)
def rare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 100 == 0, F.concat(F.lit("rare "), (F.col("p_partkey") % 7).cast("string"))).otherwise(F.col("p_brand"))
    return rounded(anomalies.rare_values(table_nodes(read(spark, sf_dir, "part").select(kind.alias("kind")))))


@register(
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (user_id % 7 = 0) AS s, count(*) FILTER (user_id % 7 = 1) AS z FROM events)
       SELECT '$[*].v' AS path, round(1 - (n - s - z) / n, 6) AS instability, 'integer' AS dominant_type, z AS n_null, s AS n_string, n - s - z AS n_integer FROM t"""
)
def type_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("user_id") % 7 == 0, '"x"').when(F.col("user_id") % 7 == 1, "null").otherwise(F.col("user_id").cast("string"))
    texts = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("body"))
    found = anomalies.type_instabilities(json_nodes(texts, "event_id", "body", root="$[*]"))
    spread = F.col("type_distribution")
    return rounded(found.select("path", "instability", "dominant_type", *[F.try_element_at(spread, F.lit(t)).alias(f"n_{t}") for t in ("null", "string", "integer")]))


def _two_shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    left = table_nodes(events.select("user_id", "event_type", "value"))
    right = table_nodes(events.select(F.col("user_id").cast("string").alias("user_id"), "event_type", "props"))
    return left, right


# the paths and types of both node tables, read from the tables
_SHAPES = """l AS (SELECT '$[*]' AS path, 'object' AS type, count(*) AS c FROM events UNION ALL SELECT '$[*].user_id', CASE typeof(max(user_id)) WHEN 'VARCHAR' THEN 'string' ELSE 'integer' END, count(user_id) FROM events
        UNION ALL SELECT '$[*].event_type', 'string', count(event_type) FROM events UNION ALL SELECT '$[*].value', 'float', count(value) FROM events),
    r AS (SELECT '$[*]' AS path, 'object' AS type, count(*) AS c FROM events UNION ALL SELECT '$[*].user_id', CASE typeof(max(user_id::VARCHAR)) WHEN 'VARCHAR' THEN 'string' ELSE 'integer' END, count(user_id) FROM events
        UNION ALL SELECT '$[*].event_type', 'string', count(event_type) FROM events UNION ALL SELECT '$[*].props', 'string', count(props) FROM events),
    d AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' ELSE 'shared' END AS status, l.type AS from_type, r.type AS to_type
          FROM (SELECT * FROM l WHERE c > 0) l FULL JOIN (SELECT * FROM r WHERE c > 0) r ON l.path = r.path)"""


@register(f"WITH {_SHAPES} SELECT path, status FROM d")
def path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.path_diff(*_two_shapes(spark, sf_dir))


@register(f"WITH {_SHAPES} SELECT count(*) FILTER (status = 'shared') AS shared, count(*) AS total, round(count(*) FILTER (status = 'shared') / count(*), 6) AS jaccard FROM d")
def path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.jaccard_of_paths(drift.path_diff(*_two_shapes(spark, sf_dir))))


@register(f"WITH {_SHAPES} SELECT path, from_type, to_type FROM d WHERE status = 'shared' AND from_type <> to_type")
def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.type_changes(*_two_shapes(spark, sf_dir))


@register(
    f"""WITH {_SHAPES}, n AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'shared') AS shared,
            count(*) FILTER (status = 'shared' AND from_type <> to_type) AS changed, count(*) AS total FROM d),
        u AS (SELECT 'user_id' AS f, user_id::VARCHAR AS v, count(*) AS a, count(*) AS b FROM events GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*), count(*) FROM events GROUP BY ALL),
        j AS (SELECT f, a / sum(a) OVER (PARTITION BY f) AS p, b / sum(b) OVER (PARTITION BY f) AS q FROM u),
        s AS (SELECT f, greatest(0, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2) AS jsd FROM j GROUP BY f),
        m AS (SELECT coalesce(max(jsd) FILTER (jsd > {drift.JSD_CUT}), 0.0) AS max_jsd, 0.0 AS max_wasserstein FROM s)
        SELECT added, removed, shared, changed, round(shared / total, 6) AS structural_similarity, round(max_jsd, 6) + 0.0 AS max_jsd, round(max_wasserstein, 6)::DOUBLE + 0.0 AS max_wasserstein,
               CASE WHEN removed > 0 THEN 'critical' WHEN changed > 0 OR max_jsd > {drift.JSD_MAJOR} THEN 'high' WHEN added > 0 THEN 'medium' WHEN max_jsd > {drift.JSD_CUT} THEN 'low' ELSE 'none' END AS severity FROM n, m"""
)
def full_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.full_drift(*_two_shapes(spark, sf_dir)))


_PAIRS = "SELECT a.g AS group_a, b.g AS group_b FROM (SELECT DISTINCT {g} AS g FROM {t}) a, (SELECT DISTINCT {g} AS g FROM {t}) b WHERE a.g < b.g"


@register(
    f"""WITH pairs AS ({_PAIRS.format(g='l_returnflag', t='lineitem')}),
        c AS (SELECT l_returnflag AS g, l_linenumber AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY l_returnflag, l_linenumber),
        v AS (SELECT DISTINCT v FROM c),
        j AS (SELECT group_a, group_b, v.v, coalesce(x.n / x.t, 0) AS p, coalesce(y.n / y.t, 0) AS q FROM pairs CROSS JOIN v
              LEFT JOIN c x ON x.g = group_a AND x.v = v.v LEFT JOIN c y ON y.g = group_b AND y.v = v.v),
        s AS (SELECT group_a, group_b, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS jsd FROM j GROUP BY ALL)
        SELECT group_a, group_b, round(jsd, 6) + 0.0 AS jsd, round(sqrt(jsd), 5) + 0.0 AS jsd_metric FROM s"""
)
def jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.lit("l").alias("path"), F.col("l_linenumber").alias("v"))
    paired = drift.paired_counts(lines, "g", "v", drift.group_pairs(lines, "g"))
    return rounded(drift.jensen_shannon(paired, ("group_a", "group_b")).withColumn("jsd_metric", F.round("jsd_metric", 5)))


_COMPARED = """
    WITH pairs AS ({pairs}),
    c AS (SELECT {g} AS g, {v} AS v, count(*) AS n FROM {t} GROUP BY ALL),
    u AS (SELECT group_a, group_b, v, sum(CASE WHEN g = group_a THEN n ELSE 0 END) AS a, sum(CASE WHEN g = group_b THEN n ELSE 0 END) AS b
          FROM pairs JOIN c ON g = group_a OR g = group_b GROUP BY ALL),
    r AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY group_a, group_b) AS na, sum(b) OVER (PARTITION BY group_a, group_b) AS nb,
                 lead(v) OVER (PARTITION BY group_a, group_b ORDER BY v) - v AS step
          FROM u WINDOW w AS (PARTITION BY group_a, group_b ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT group_a, group_b, round(sum(coalesce(step, 0) * abs(ca / na - cb / nb)), 6) + 0.0 AS wasserstein,
           round(sum(a * ((cb - b) - (nb - cb)))::DOUBLE / (max(na) * max(nb)), 6) + 0.0 AS cliffs_delta,
           round((sum(a * ((cb - b) - (nb - cb)))::DOUBLE / (max(na) * max(nb)) + 1) / 2, 6) + 0.0 AS auc
    FROM r GROUP BY ALL"""


@register(_COMPARED.format(pairs=_PAIRS.format(g="event_type", t="events"), g="event_type", v="value", t="events"))
def wasserstein_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.lit("v").alias("path"), F.col("value").alias("num"))
    paired = drift.paired_counts(rows, "g", "num", drift.group_pairs(rows, "g"))
    return rounded(drift.ordered_comparison(paired, ("group_a", "group_b")))


@register(
    "SELECT group_a, group_b, '$[*].value' AS path, 'wasserstein' AS metric, wasserstein AS value, abs(cliffs_delta) AS effect_size FROM ("
    + _COMPARED.format(pairs=_PAIRS.format(g="event_type", t="events"), g="event_type", v="value", t="events")
    + ") WHERE wasserstein > 0.1"
)
def population_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table_nodes(read(spark, sf_dir, "events").withColumn("g", F.col("event_type")), ["value"], keep=["g"])
    return rounded(drift.population_drift(nodes, "g"))


_RELATION = """
    WITH j AS ({joint}), t AS (SELECT sum(n) AS t FROM j),
    x AS (SELECT x, sum(n) AS nx FROM j GROUP BY x), y AS (SELECT y, sum(n) AS ny FROM j GROUP BY y),
    h AS (SELECT (SELECT -sum(nx / t * log2(nx / t)) FROM x, t) AS hx, (SELECT -sum(ny / t * log2(ny / t)) FROM y, t) AS hy, (SELECT -sum(n / t * log2(n / t)) FROM j, t) AS hxy),
    p AS (SELECT avg(log2(n * t / (nx * ny))) AS pmi FROM j JOIN x USING (x) JOIN y USING (y), t)
    SELECT '{a}' AS field_x, '{b}' AS field_y, round(greatest(0, hxy - hx), 6) + 0.0 AS conditional_entropy, round(pmi, 6) + 0.0 AS mean_pmi,
           round(greatest(0, hx + hy - hxy), 6) + 0.0 AS mutual_information, round(1 - greatest(0, hxy - hx) / hy, 6) + 0.0 AS relationship_strength FROM h, p"""


def _sql_relation(table: str, columns: tuple[str, ...], text: dict[str, str] | None = None) -> str:
    of = lambda c: (text or {}).get(c, f"CAST({c} AS VARCHAR)")
    return " UNION ALL ".join(
        f"({_RELATION.format(joint=f'SELECT {of(a)} AS x, {of(b)} AS y, count(*) AS n FROM {table} GROUP BY ALL', a=a, b=b)})" for a in columns for b in columns if a != b
    )


LINE_FIELDS = ("l_returnflag", "l_linestatus", "l_linenumber")


@register(_sql_relation("lineitem", LINE_FIELDS))
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.discover(read(spark, sf_dir, "lineitem"), list(LINE_FIELDS)))


@register(
    "WITH cuts AS (SELECT list(v ORDER BY v) AS s, count(*) AS n FROM (SELECT l_quantity AS v FROM lineitem)), binned AS (SELECT l_returnflag, "
    + "(" + " + ".join(f"CAST(s[(({i} * n) // 5 + 1)::BIGINT] < l_quantity AS INT)" for i in range(1, 5)) + ")::VARCHAR AS l_quantity FROM lineitem, cuts) SELECT * FROM ("
    + _sql_relation("binned", ("l_returnflag", "l_quantity"))
    + ")"
)
def invariants_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.discover(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_quantity"], bins=5))


@register(
    "WITH j AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j), s AS ("
    + " UNION ALL ".join(f"SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY {c}), t" for c in LINE_FIELDS)
    + "), w AS (SELECT -sum(n / t * log2(n / t)) AS h FROM j, t) SELECT round(sum(s.h), 6) AS sum_entropy, round(max(w.h), 6) AS joint_entropy, round(greatest(0, sum(s.h) - max(w.h)), 6) AS total_correlation FROM s, w"
)
def total_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.total_correlation(read(spark, sf_dir, "lineitem"), list(LINE_FIELDS)))


@register(
    """WITH s AS (SELECT event_type AS y, lag(event_type) OVER w AS yp, lag(floor(value / 20)) OVER w AS xp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       j AS (SELECT y, yp, xp, count(*) AS n FROM s WHERE yp IS NOT NULL AND xp IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j),
       a AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY y, yp), t), b AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY yp), t),
       c AS (SELECT -sum(n / t * log2(n / t)) AS h FROM j, t), d AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY yp, xp), t)
       SELECT (SELECT t FROM t)::BIGINT AS transitions, round(greatest(0, (a.h - b.h) - (c.h - d.h)), 6) AS transfer_entropy FROM a, b, c, d"""
)
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("x", F.floor(F.col("value") / 20))
    return rounded(relations.transfer_entropy(events, "user_id", ["ts", "event_id"], "x", "event_type"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("lang", "source", "n_chars", "quality", "toxic")


_LABELLED = "(SELECT lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"
_SEPARATION = """
    SELECT '{f}' AS feature, t::BIGINT AS count, round(present / t, 6) AS coverage, kinds AS distinct_values, round(greatest(0, hl + hv - hj), 6) AS mutual_information,
           round(greatest(0, hj - hv), 6) AS conditional_entropy, round(1 - greatest(0, hj - hv) / hl, 6) AS relationship_strength
    FROM (SELECT (SELECT count(*) FROM {d}) AS t, (SELECT count({f}) FROM {d}) AS present, (SELECT count(DISTINCT {f}) FROM {d}) AS kinds,
                 (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {d} GROUP BY {f})) AS hv,
                 (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {d} GROUP BY quality)) AS hl,
                 (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {d} GROUP BY {f}, quality)) AS hj)"""


@register(" UNION ALL ".join(f"({_SEPARATION.format(f=f, d=_LABELLED)})" for f in ("lang", "source")))
def label_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(separation.separation(_labelled(spark, sf_dir), "quality", ["lang", "source"]))


_ROC = f"""
    c AS (SELECT n_chars::DOUBLE AS v, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM {_LABELLED} GROUP BY ALL),
    r AS (SELECT v, a, b, coalesce(sum(a) OVER w, 0) AS ca, coalesce(sum(b) OVER w, 0) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
          FROM c WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register(
    f"WITH {_ROC} SELECT 'n_chars' AS feature, round((sum(a * (cb - (nb - cb - b)))::DOUBLE / (max(na) * max(nb)) + 1) / 2, 6) AS auc, "
    "round(abs(sum(a * (cb - (nb - cb - b)))::DOUBLE / (max(na) * max(nb))), 6) AS separation FROM r"
)
def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(separation.auc(_labelled(spark, sf_dir), "quality", "1", ["n_chars"]))


@register(
    f"""WITH {_ROC}, p AS (SELECT v, 1 - ca / na AS t, 1 - cb / nb AS f, na, nb FROM r), m AS (SELECT * FROM p ORDER BY abs(t - f) DESC, v LIMIT 1),
        o AS (SELECT v, CASE WHEN t >= f THEN '>=' ELSE '<' END AS rule, CASE WHEN t >= f THEN t ELSE 1 - t END AS tpr, CASE WHEN t >= f THEN f ELSE 1 - f END AS fpr, abs(t - f) AS j, na / (na + nb) AS rate FROM m)
        SELECT 'n_chars' AS feature, rule, v AS threshold, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr, round(j, 6) AS youden_j, round(tpr * rate / (tpr * rate + fpr * (1 - rate)), 6) AS precision_at_base_rate FROM o"""
)
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(separation.operating_point(_labelled(spark, sf_dir), "quality", "1", ["n_chars"]))


_LABELS = {"month": "strftime(ts, '%Y-%m')", "week": "strftime(ts, '%G-W%V')", "day": "strftime(ts, '%Y-%m-%d')"}
_WINDOWED = """
    WITH c AS (SELECT {label} AS win, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT win, n, n / sum(n) OVER (PARTITION BY win) AS p FROM c)
    SELECT win AS "window", 'event_type' AS field, sum(n)::BIGINT AS record_count, round(greatest(0, -sum(p * log2(p))), 6) + 0.0 AS entropy, count(*) AS cardinality FROM s GROUP BY win"""


def _windowed(window: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(temporal.windowed(read(spark, sf_dir, "events"), "ts", window, ["event_type"]))

    run.__name__ = f"window_{window}"
    return run


for _w, _label in _LABELS.items():
    register(_WINDOWED.format(label=_label))(_windowed(_w))


@register(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS w, count(*) AS y, avg(o_totalprice) AS z FROM orders GROUP BY ALL),
       x AS (SELECT y, z, (row_number() OVER (ORDER BY w) - 1)::DOUBLE AS x FROM m)
       SELECT 'record_count' AS name, round(regr_slope(y, x), 4) AS slope, round(regr_r2(y, x), 6) AS r_squared, CASE WHEN regr_r2(y, x) <= 0.3 THEN 'stable' WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM x
       UNION ALL SELECT 'price', round(regr_slope(z, x), 4), round(regr_r2(z, x), 6), CASE WHEN regr_r2(z, x) <= 0.3 THEN 'stable' WHEN regr_slope(z, x) > 0 THEN 'increasing' ELSE 'decreasing' END FROM x"""
)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = read(spark, sf_dir, "orders").groupBy(temporal.window_label(F.col("o_orderdate"), "month").alias("w")).agg(F.count("*").cast("double").alias("record_count"), F.avg("o_totalprice").alias("price"))
    points = months.unpivot(["w"], ["record_count", "price"], "name", "y")
    return rounded(temporal.trend(points, ["name"], "w", "y").withColumn("slope", F.round("slope", 4)))


@register(
    """WITH s AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), g AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS gap FROM s),
       m AS (SELECT event_type, median(gap) AS med, mad(gap) AS d FROM g WHERE gap IS NOT NULL GROUP BY ALL)
       SELECT event_type, round(med, 6) AS median_gap, round(d, 6) AS mad_gap, count(*) + 1 AS events, count(*) FILTER (gap = 0) AS duplicates, count(*) FILTER (med + 3 * d > 0 AND gap > med + 3 * d) AS n_gaps
       FROM g JOIN m USING (event_type) WHERE gap IS NOT NULL GROUP BY ALL"""
)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts")))
    return rounded(temporal.gaps(events, ["event_type"], "ts"))


@register(
    """WITH d AS (SELECT o_orderkey % 6 AS k, o_orderdate AS t FROM orders),
       s AS (SELECT CASE k WHEN 0 THEN 'iso_datetime' WHEN 1 THEN 'iso_date' WHEN 2 THEN 'us_date' WHEN 3 THEN 'eu_date' WHEN 4 THEN 'epoch' END AS kind,
                    CASE WHEN k = 0 THEN epoch(date_trunc('day', t))::BIGINT WHEN k = 4 THEN 1000000000 WHEN k < 4 THEN epoch(date_trunc('day', t))::BIGINT END AS e FROM d)
       SELECT kind, count(*) AS n, min(e) AS first, max(e) AS last FROM s GROUP BY kind"""
)
def date_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T00:00:00Z'"))
        .when(k == 1, F.date_format(t, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(t, "M/d/yyyy"))
        .when(k == 3, F.date_format(t, "d.M.yyyy"))
        .when(k == 4, F.lit("1000000000"))
        .otherwise(F.lit("no date"))
    )
    rows = read(spark, sf_dir, "orders").select(text.alias("s"))
    return rows.groupBy(temporal.date_kind(F.col("s")).alias("kind")).agg(F.count("*").alias("n"), F.unix_seconds(F.min(temporal.parse_time(F.col("s")))).alias("first"), F.unix_seconds(F.max(temporal.parse_time(F.col("s")))).alias("last"))


_CASCADE = """c AS (SELECT user_id AS entity, event_type AS trigger, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS response FROM events),
    f AS (SELECT * FROM c WHERE trigger NOT LIKE '%error%' AND response LIKE '%error%')"""


def _cascades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    return events, temporal.cascades(events, "user_id", ["ts", "event_id"], "event_type", ["error"])


@register(f"WITH {_CASCADE} SELECT trigger, response, count(*) AS n, count(DISTINCT entity) AS entities FROM f GROUP BY ALL")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascades(spark, sf_dir)[1].groupBy("trigger", "response").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@register(
    f"""WITH {_CASCADE}, t AS (SELECT user_id AS entity, count(*) AS total FROM events GROUP BY ALL), h AS (SELECT entity, count(*) AS k FROM f GROUP BY ALL), z AS (SELECT 1.959963984540054 AS z)
        SELECT entity, total, k AS cascades, round(k / total, 6) AS cascade_ratio,
        round(greatest(0, (k / total + z * z / (2 * total) - z * sqrt(k / total * (1 - k / total) / total + z * z / (4 * total * total))) / (1 + z * z / total)), 6) AS cascade_ratio_lower_bound
        FROM t JOIN h USING (entity), z"""
)
def hot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, found = _cascades(spark, sf_dir)
    return rounded(temporal.hot_entities(events, found, "user_id", "event_type"))


@register(
    """WITH c AS (SELECT o_custkey AS a, count(*) AS n FROM orders GROUP BY ALL),
       r AS (SELECT a, n, row_number() OVER (ORDER BY n DESC, a) AS k, sum(n) OVER (ORDER BY n DESC, a ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY n, a) AS i, sum(n) OVER () AS t, count(*) OVER () AS people FROM c)
       SELECT max(t)::BIGINT AS total_items, max(people) AS unique_authors, min(k) FILTER (upto >= ceil(t * 0.5)) AS bus_factor_50, min(k) FILTER (upto >= ceil(t * 0.8)) AS bus_factor_80,
              round(-sum(n / t * log2(n / t)), 6) AS author_entropy, round(2 * sum(i * n) / (max(people) * max(t)) - (max(people) + 1) / max(people), 6) AS gini_coefficient,
              round(sum(n) FILTER (k <= 1) / max(t), 6) AS top1_share, round(sum(n) FILTER (k <= 3) / max(t), 6) AS top3_share, round(sum(n) FILTER (k <= 5) / max(t), 6) AS top5_share,
              round(count(*) FILTER (n = 1) / max(people), 6) AS one_commit_rate FROM r"""
)
def governance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(governance.concentration(governance.author_counts(read(spark, sf_dir, "orders"), "o_custkey")))


@register(
    """WITH r AS (SELECT DISTINCT o_custkey AS a, strftime(o_orderdate, '%Y-%m') AS mth FROM orders), m AS (SELECT mth, row_number() OVER (ORDER BY mth) AS k FROM (SELECT DISTINCT mth FROM r)),
       s AS (SELECT a, mth, k, min(k) OVER (PARTITION BY a) = k AS is_new, lead(k) OVER (PARTITION BY a ORDER BY k) AS nxt FROM r JOIN m USING (mth)),
       l AS (SELECT k + 1 AS k, count(*) AS lost FROM s WHERE nxt IS NULL OR nxt > k + 1 GROUP BY ALL)
       SELECT mth AS month, count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS returning, coalesce(max(lost), 0) AS churned, count(*) AS active, count(*) FILTER (is_new) - coalesce(max(lost), 0) AS net
       FROM s LEFT JOIN l USING (k) GROUP BY mth"""
)
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.churn(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@register("SELECT round(median(s) / 86400, 6) AS contributor_half_life_days FROM (SELECT epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS s FROM orders GROUP BY o_custkey)")
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(governance.half_life(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate"))


# authors of orders: most by a company's addresses, some by providers', some bots by name, marker or address
_AUTHORS = """(SELECT CASE WHEN k % 40 = 7 THEN 'b' || k || '[bot]' WHEN k % 40 = 9 THEN 'app/' || k ELSE 'c' || k END AS author,
    CASE WHEN k % 40 = 11 THEN k || '+x[bot]@users.noreply.github.com' WHEN k % 40 = 13 THEN 'build-bot@other.example' WHEN k % 40 = 15 THEN 'talbot' || k || '@gmail.com'
         WHEN k % 4 = 0 THEN 'c' || k || '@GMX.net' WHEN k % 5 = 1 THEN '' ELSE 'c' || k || '@corp.example' END AS email, strftime(o_orderdate, '%Y-%m') AS mth
    FROM (SELECT o_custkey AS k, o_orderdate FROM orders))"""


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    k, text = F.col("o_custkey"), F.col("o_custkey").cast("string")
    name = F.when(k % 40 == 7, F.concat(F.lit("b"), text, F.lit("[bot]"))).when(k % 40 == 9, F.concat(F.lit("app/"), text)).otherwise(F.concat(F.lit("c"), text))
    mail = (
        F.when(k % 40 == 11, F.concat(text, F.lit("+x[bot]@users.noreply.github.com")))
        .when(k % 40 == 13, "build-bot@other.example")
        .when(k % 40 == 15, F.concat(F.lit("talbot"), text, F.lit("@gmail.com")))
        .when(k % 4 == 0, F.concat(F.lit("c"), text, F.lit("@GMX.net")))
        .when(k % 5 == 1, "")
        .otherwise(F.concat(F.lit("c"), text, F.lit("@corp.example")))
    )
    return orders.select(name.alias("author"), mail.alias("email"), "o_orderdate")


@register(
    f"""WITH c AS (SELECT author, email, count(*) AS n, count(DISTINCT mth) AS months FROM {_AUTHORS} GROUP BY ALL), m AS (SELECT count(DISTINCT mth) AS m FROM {_AUTHORS}),
       l AS (SELECT *, regexp_replace(split_part(lower(email), '@', 1), '^[0-9]+\\+', '') AS loc, CASE WHEN email LIKE '%@%' THEN lower(split_part(email, '@', -1)) END AS domain FROM c),
       b AS (SELECT *, CASE WHEN author LIKE '%[bot]' THEN 'bot_suffix' WHEN author LIKE 'app/%' THEN 'bot_app_prefix' WHEN loc LIKE '%[bot]%' THEN 'bot_email_marker'
                       WHEN loc = 'bot' OR ends_with(loc, '-bot') OR ends_with(loc, '_bot') OR ends_with(loc, '.bot') OR starts_with(loc, 'bot-') OR starts_with(loc, 'bot_') OR starts_with(loc, 'bot.') THEN 'bot_email_local_part' END AS bot FROM l),
       p AS (SELECT author, email, (sum(n) OVER (ORDER BY n DESC, author || ' <' || email || '>' ROWS UNBOUNDED PRECEDING) - n) * 5 < sum(n) OVER () * 4 AS vol FROM b WHERE bot IS NULL),
       d AS (SELECT domain, sum(n) AS s, (SELECT sum(n) FROM b WHERE bot IS NULL) AS t FROM b WHERE bot IS NULL AND domain IS NOT NULL
             AND domain NOT IN ({', '.join(f"'{x}'" for x in governance.GENERIC_DOMAINS)}) GROUP BY domain ORDER BY s DESC, domain DESC LIMIT 1),
       x AS (SELECT b.*, coalesce(vol, false) AS vol, coalesce(b.domain = d.domain AND d.s * 2 > d.t, false) AS dom, months * 2 > m AS often, months * 5 < m AS seldom FROM b LEFT JOIN p USING (author, email) LEFT JOIN d ON true, m)
       SELECT author, email, n, months, CASE WHEN bot IS NOT NULL THEN 'bot' WHEN dom OR (vol AND NOT seldom) THEN 'core' ELSE 'community' END AS role,
              CASE WHEN bot = 'bot_email_local_part' THEN 'dominant' WHEN bot IS NOT NULL THEN 'definite' WHEN dom OR (vol AND often) THEN 'dominant' ELSE 'heuristic' END AS confidence,
              CASE WHEN bot IS NOT NULL THEN bot WHEN dom THEN 'email_domain:' || domain || CASE WHEN vol THEN '+pareto_80pct' ELSE '' END
                   WHEN vol THEN 'pareto_80pct' || CASE WHEN seldom THEN '+temporal_sporadic' WHEN often THEN '+temporal_consistent' ELSE '' END ELSE 'community_default' END AS reason FROM x"""
)
def core_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.core_team(_authors(spark, sf_dir), "author", "o_orderdate", "email")


def _sql_grade(metric: str, value: str) -> str:
    sign, steps = governance.LADDERS[metric]
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} {sign} {limit} THEN '{g}'" for limit, g in steps) + " ELSE 'F' END"


_SQL_POINTS = "CASE {g} " + " ".join(f"WHEN '{g}' THEN {p}" for g, p in governance.POINTS.items()) + " END"
_HEALTH_METRICS = ("top1_share", "commit_entropy", "one_commit_rate")
_GRADED = {n: (w, m) for n, (w, m) in governance.DIMENSIONS.items() if m in _HEALTH_METRICS}


@register(
    f"""WITH c AS (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey), t AS (SELECT sum(n) AS t FROM c),
       m AS (SELECT max(n) / max(t) AS top1_share, -sum(n / t * log2(n / t)) AS commit_entropy, count(*) FILTER (n = 1) / count(*) AS one_commit_rate FROM c, t),
       g AS (SELECT *, {', '.join(f"{_sql_grade(m, m) if n in _GRADED else 'NULL::VARCHAR'} AS grade_{n}" for n, (_, m) in governance.DIMENSIONS.items())} FROM m),
       s AS (SELECT *, ({' + '.join(f"{w} * {_SQL_POINTS.format(g=f'grade_{n}')}" for n, (w, _) in _GRADED.items())})::DOUBLE / {sum(w for w, _ in _GRADED.values())} AS score FROM g)
       SELECT * EXCLUDE (score, top1_share, commit_entropy, one_commit_rate), round(top1_share, 6) AS top1_share, round(commit_entropy, 6) AS commit_entropy, round(one_commit_rate, 6) AS one_commit_rate,
              round(score, 6) AS score, CASE {' '.join(f"WHEN score >= {limit} THEN '{g}'" for limit, g in governance.LETTERS)} ELSE 'F' END AS overall_grade FROM s"""
)
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = governance.concentration(governance.author_counts(read(spark, sf_dir, "orders"), "o_custkey"))
    metrics = report.select("top1_share", F.col("author_entropy").alias("commit_entropy"), "one_commit_rate")
    return rounded(governance.health(metrics))


@register(
    """WITH RECURSIVE p AS (SELECT 'u' || (user_id % 50) AS name, 'm' || (user_id % 75) || '@example.org' AS email, count(*) AS n FROM events GROUP BY ALL),
       r AS (SELECT name AS a, name AS b FROM p UNION SELECT r.a, q.name FROM r JOIN p o ON o.name = r.b JOIN p q ON q.email = o.email),
       l AS (SELECT a AS name, min(b) AS identity FROM r GROUP BY a),
       t AS (SELECT identity, name, sum(n) AS n FROM p JOIN l USING (name) GROUP BY ALL),
       f AS (SELECT identity, name AS canonical FROM t QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n DESC, name) = 1)
       SELECT name, email, identity, canonical FROM p JOIN l USING (name) JOIN f USING (identity)"""
)
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    people = events.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("name"), F.concat(F.lit("12345+m"), (F.col("user_id") % 75).cast("string"), F.lit("@Example.org")).alias("email"))
    return governance.identities(people, "name", "email")


@register(
    """WITH k AS (SELECT event_id, unnest(json_keys(props)) AS k FROM events),
       s AS (SELECT e.event_id, '$' || coalesce((SELECT string_agg(chr(1) || '$.' || k, '' ORDER BY k) FROM k WHERE k.event_id = e.event_id), '') AS t FROM events e)
       SELECT sha256(t) AS path_set, count(*) AS documents FROM s GROUP BY t"""
)
def shape_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_nodes(read(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")
    return fingerprints.shape_fingerprints(nodes).groupBy("path_set").agg(F.count("*").alias("documents"))


@register("SELECT path, type, count(*) AS count, round(sum(num), 6) AS total FROM (SELECT '$' AS path, 'object' AS type, NULL::DOUBLE AS num FROM events UNION ALL SELECT '$.k', 'integer', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events) GROUP BY ALL")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_nodes(read(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")
    return rounded(nodes.groupBy("path", "type").agg(F.count("*").alias("count"), F.sum("num").alias("total")))


@register(
    """WITH k AS (SELECT event_id, '$.' || unnest(json_keys(props)) AS path FROM events UNION ALL SELECT event_id, '$' FROM events), n AS (SELECT count(DISTINCT event_id) AS n FROM k)
       SELECT path, count(DISTINCT event_id) AS documents, count(DISTINCT event_id) >= ceil(max(n) * 0.5) AS common,
              CASE WHEN max(n) <= 10 THEN count(DISTINCT event_id) < 2 ELSE count(DISTINCT event_id) < ceil(max(n) * 0.1) END AS rare FROM k, n GROUP BY path"""
)
def batch_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.batch_aggregate(json_nodes(read(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props"))


@register()
def merkle_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.repeated_motifs(fingerprints.merkle_shapes(read(spark, sf_dir, "events"), "event_id", "props"))


@register()
def corpus_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    shapes = fingerprints.merkle_shapes(events, "event_id", "props").join(events.select("event_id", "event_type"), "event_id")
    return fingerprints.corpus_reuse(shapes, "event_id", "event_type")


@register(
    """WITH s AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS i FROM lineitem), n AS (SELECT d, count(*) AS n FROM s GROUP BY d),
       b AS (SELECT x.d AS a, y.d AS b, count(*) AS c FROM s x JOIN s y ON x.i = y.i AND x.d < y.d GROUP BY ALL)
       SELECT b.a, b.b, round(c / (p.n + q.n - c), 6) AS jaccard FROM b JOIN n p ON p.d = b.a JOIN n q ON q.d = b.b WHERE c / (p.n + q.n - c) > 0.5"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fingerprints.jaccard_pairs(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))


@register()
def minhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("i"))
    return fingerprints.clusters(lines, "d", fingerprints.similar_links(lines, "d", "i"))


@register()
def lz_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    joined = events.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_set(F.col("user_id").cast("string"))), "\x01").alias("t"))
    return rounded(joined.select("event_type", complexity.lz_complexity("t").alias("lz_complexity")))


@register()
def ncd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.repeat(F.col("n_name"), 20).alias("t"))
    a, b = nations.select(F.col("k").alias("a"), F.col("t").alias("x")), nations.select(F.col("k").alias("b"), F.col("t").alias("y"))
    sizes = a.join(b, F.col("a") < F.col("b")).select("a", "b", complexity.zstd_size("x").alias("sx"), complexity.zstd_size("y").alias("sy"), complexity.zstd_size(F.concat("x", "y")).alias("sxy"))
    return rounded(sizes.select("a", "b", complexity.ncd(F.col("sx"), F.col("sy"), F.col("sxy")).alias("ncd")))


_WORDS = "SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents"


@register(
    "WITH d AS (SELECT w, count(*) AS c FROM (" + _WORDS + ") GROUP BY w) SELECT semantic_type, sum(c)::BIGINT AS n FROM (SELECT c, CASE "
    + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{n}'" for g, n, _, p in recognizers.RECOGNIZERS if g != "encoding")
    + " END AS semantic_type FROM d) WHERE semantic_type IS NOT NULL GROUP BY ALL"
)
def recognized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first recognizer of six groups makes of each word, counted before it is tested; ``recognized_groups`` has the seventh too, which decodes."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    every = tuple(dict.fromkeys(g for g, _, _, _ in recognizers.RECOGNIZERS if g != "encoding"))
    return words.select("c", recognizers.recognize(F.col("w"), every).alias("semantic_type")).where("semantic_type is not null").groupBy("semantic_type").agg(F.sum("c").alias("n"))


@register()
def recognized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each recognizer of the seven groups matches, also where another one comes before it."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    named = [(g, n) for g, n, _, _ in recognizers.RECOGNIZERS] + [("encoding", n) for n in recognizers.DECODED]
    found = F.array(*[F.when(recognizers.matches(F.col("w"), n), F.struct(F.lit(g).alias("domain"), F.lit(n).alias("semantic_type"))) for g, n in named])
    matched = words.select("c", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return matched.groupBy("f.domain", "f.semantic_type").agg(F.sum("c").alias("n"))


_RULES = dict(redaction.RULES)


def _sql_plain(rule: str) -> str:
    return f"WHEN regexp_matches(text, '{_RULES[rule]}') THEN regexp_replace(text, '{_RULES[rule]}', '[{rule}]', 'g')"


# the digits of a card from the last on, each second one doubled, have a sum that ten divides
_SQL_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(d)[i]::INT
    ELSE 2 * reverse(d)[i]::INT - CASE WHEN reverse(d)[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


@register(
    f"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_RULES["CREDIT_CARD"]}', 1)) AS card FROM documents),
        v AS (SELECT doc_id, card FROM (SELECT doc_id, card, regexp_replace(card, '[^0-9]', '', 'g') AS d FROM m) WHERE len(d) BETWEEN 13 AND 19 AND {_SQL_LUHN}),
        k AS (SELECT doc_id, list(card ORDER BY len(card) DESC, card) AS cards FROM v GROUP BY doc_id),
        d AS (SELECT doc_id, text, CASE {" ".join(_sql_plain(n) for n in ("SSN", "EMAIL", "PHONE"))}
                 WHEN cards IS NOT NULL THEN list_reduce(list_concat([text], cards), lambda t, c: replace(t, c, '[CREDIT_CARD]'))
                 {_sql_plain("DATE_OF_BIRTH").replace("WHEN ", "WHEN dob AND ")} ELSE text END AS redacted FROM (SELECT doc_id, text, doc_id % 2 = 0 AS dob FROM documents) LEFT JOIN k USING (doc_id))
        SELECT doc_id, md5(redacted) AS digest FROM d WHERE redacted <> text"""
)
def redaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules; every other document stands under a key that speaks of a birth."""
    key = F.when(F.col("doc_id") % 2 == 0, "birthday").otherwise("text")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", redaction.redact(F.col("text"), key).alias("redacted"))
    return docs.where("redacted <> text").select("doc_id", F.md5("redacted").alias("digest"))


@register(
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)
       SELECT 'entropy' AS query, '$[*].event_type' AS path, round(-sum(n / t * log2(n / t)), 6) AS value FROM c, (SELECT count(*) AS t FROM events) GROUP BY ALL
       UNION ALL SELECT 'rarity', '$[*].event_type', round(-log2(min(n) / (SELECT count(*) FROM events)), 6) FROM c
       UNION ALL SELECT 'null_rate', '$[*].value', round(1 - count(value) / count(*), 6) FROM events
       UNION ALL SELECT 'instability', '$[*].value', round(1 - greatest(count(value), count(*) - count(value)) / count(*), 6) FROM events
       UNION ALL SELECT 'cardinality', '$[*].user_id', count(DISTINCT user_id)::DOUBLE FROM events
       UNION ALL SELECT 'count', '$[*].value', count(*)::DOUBLE FROM events UNION ALL SELECT 'depth', '$[*].value', 2.0
       UNION ALL SELECT 'paths', p, count(*)::DOUBLE FROM events, (VALUES ('$[*]'), ('$[*].event_type'), ('$[*].user_id'), ('$[*].value')) t(p) GROUP BY p"""
)
def query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table_nodes(read(spark, sf_dir, "events").select("event_type", "user_id", "value"))
    asked = {"rarity": "rarity($[*].event_type) > 0", "null_rate": "null_rate($[*].value) <= 1", "instability": "instability($[*].value) >= 0", "entropy": "entropy($[*].event_type)", "cardinality": "cardinality($[*].user_id) > 1", "count": "count($[*].value)", "depth": "depth($.**.value) == 2", "paths": "$.** > 0"}
    out = None
    for name, text in asked.items():
        one = query.run(nodes, text).select(F.lit(name).alias("query"), "path", "value")
        out = one if out is None else out.union(one)
    return rounded(out)


@register()
def sketch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sketches.read_sketches(sketches.merge_sketches(sketches.path_sketches(table_nodes(read(spark, sf_dir, "lineitem"), list(LINE_NUMBERS))))))


@register()
def sketch_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.approximate_top(table_nodes(read(spark, sf_dir, "events"), ["event_type", "user_id"]))


@register(
    f"""WITH g AS (SELECT ln(1.01 / 0.99) AS g), b AS (SELECT path, ceil(ln(num) / g)::INT AS k, count(*) AS c FROM ({sql_numbers('lineitem', ('l_extendedprice', 'l_quantity'))}), g GROUP BY ALL),
        r AS (SELECT path, k, c, sum(c) OVER (PARTITION BY path ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY path) AS n FROM b),
        q AS (SELECT *, round(q * (n - 1)) + 1 AS rank FROM r, (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) t(q))
        SELECT path, q, round(exp(k * g), 4) AS value FROM q, g WHERE rank <= upto AND rank > upto - c"""
)
def ddsketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.ddsketch(table_nodes(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]))
    return found.select("path", F.col("q").cast("double").alias("q"), F.round("value", 4).alias("value"))


@register()
def adaptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sketches.adaptive_statistics(table_nodes(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_returnflag"]), limit=1000))


@register()
def essence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table_nodes(read(spark, sf_dir, "events"), ["event_type", "user_id", "value"], F.col("event_id"))
    stats = profile.value_statistics(profile.value_frequency(nodes))
    paths = profile.path_inventory(nodes)
    found = essence.from_statistics(stats).union(essence.from_anomalies(anomalies.numeric_outliers(nodes), anomalies.rare_values(nodes), anomalies.type_instabilities(nodes))).union(essence.from_inventory(paths))
    return rounded(essence.score(found, essence.profile("engineer")))


_COMPARE = """SELECT o_orderstatus AS dataset, max(t)::BIGINT AS total_items, max(people) AS unique_authors, min(k) FILTER (upto >= ceil(t * 0.5)) AS bus_factor_50, min(k) FILTER (upto >= ceil(t * 0.8)) AS bus_factor_80,
              round(-sum(n / t * log2(n / t)), 6) AS author_entropy, round(2 * sum(i * n) / (max(people) * max(t)) - (max(people) + 1) / max(people), 6) AS gini_coefficient,
              round(sum(n) FILTER (k <= 1) / max(t), 6) AS top1_share, round(sum(n) FILTER (k <= 3) / max(t), 6) AS top3_share, round(sum(n) FILTER (k <= 5) / max(t), 6) AS top5_share,
              round(count(*) FILTER (n = 1) / max(people), 6) AS one_commit_rate, max(months) AS months FROM r JOIN m USING (o_orderstatus) GROUP BY o_orderstatus"""


@register(
    """WITH c AS (SELECT o_orderstatus, o_custkey AS a, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL), m AS (SELECT o_orderstatus, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders GROUP BY ALL),
       r AS (SELECT o_orderstatus, a, n, row_number() OVER (w ORDER BY n DESC, a) AS k, sum(n) OVER (w ORDER BY n DESC, a ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (w ORDER BY n, a) AS i,
                    sum(n) OVER (w) AS t, count(*) OVER (w) AS people FROM c WINDOW w AS (PARTITION BY o_orderstatus)) """
    + _COMPARE
)
def dataset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    parts = {s: orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return rounded(compare.dataset_metrics(parts, "o_custkey", "o_orderdate"))


@register()
def dataset_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_linenumber")
    parts = {f: table_nodes(lines.where(F.col("l_returnflag") == f).drop("l_returnflag")) for f in ("A", "N", "R")}
    return rounded(compare.pairwise_drift(parts))


_HINTS = (("status_of_line", ("l_returnflag", "l_linestatus"), 0.9), ("number_of_line", ("l_linenumber", "l_linestatus"), 0.5), ("absent", ("l_linenumber", "nowhere"), 0.5))


@register(
    f"""WITH h AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {w}::DOUBLE, '{f}')" for n, fs, w in _HINTS for f in fs)}) t(name, weight, field)),
        c AS (SELECT unnest(['$[*].l_returnflag', '$[*].l_linestatus', '$[*].l_linenumber']) AS path FROM (SELECT 1 FROM lineitem LIMIT 1)),
        p AS (SELECT h.*, path FROM h JOIN c ON split_part(path, '.', -1) = field), r AS ({_sql_relation("lineitem", LINE_FIELDS)}),
        s AS (SELECT x.name, max(relationship_strength) AS m FROM p x JOIN p y ON x.name = y.name AND x.field <> y.field JOIN r ON r.field_x = x.field AND r.field_y = y.field GROUP BY x.name)
        SELECT p.name, 'dependency' AS relationship, weight, list(path ORDER BY path) AS matched_fields, max(coalesce(m, 0)) >= 0.25 AS observed, round(max(coalesce(m, 0)), 6) AS max_strength
        FROM p LEFT JOIN s USING (name) GROUP BY ALL HAVING count(DISTINCT field) >= 2"""
)
def hint_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(*LINE_FIELDS)
    hints = [compare.Hint(n, fs, "dependency", w) for n, fs, w in _HINTS]
    paths = table_nodes(lines).select("path").distinct()
    return rounded(compare.evaluate_hints(hints, paths, relations.discover(lines)))


# a table of pull requests made of orders, for the hints of that domain
_PULLS = """(SELECT 'a' || (o_custkey % 20) AS author, 'a' || (o_custkey % 20) AS pr_author, 'r' || (o_custkey % 4) AS reviewer, o_orderstatus AS state, o_orderpriority AS review_state FROM orders)"""
_PULL_FIELDS = ("author", "pr_author", "reviewer", "state", "review_state")


@register(
    f"""WITH h AS (SELECT * FROM (VALUES {', '.join(f"('{h.name}', '{h.relationship}', {h.weight}::DOUBLE, '{compare.trailing_key(f)}')" for hs in compare.HINTS.values() for h in hs for f in h.fields)}) t(name, relationship, weight, field)),
        c AS (SELECT unnest([{', '.join(f"'$[*].{f}'" for f in _PULL_FIELDS)}]) AS path FROM (SELECT 1 FROM orders LIMIT 1)),
        p AS (SELECT h.*, path FROM h JOIN c ON split_part(path, '.', -1) = field), r AS ({_sql_relation(_PULLS, _PULL_FIELDS)}),
        s AS (SELECT x.name, max(relationship_strength) AS m FROM p x JOIN p y ON x.name = y.name AND x.field <> y.field JOIN r ON r.field_x = x.field AND r.field_y = y.field GROUP BY x.name)
        SELECT p.name, relationship, weight, list(path ORDER BY path) AS matched_fields, max(coalesce(m, 0)) >= 0.25 AS observed, round(max(coalesce(m, 0)), 6) AS max_strength
        FROM p LEFT JOIN s USING (name) GROUP BY ALL HAVING count(DISTINCT field) >= 2"""
)
def domain_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hints of the six domains, over pull requests."""
    person = F.concat(F.lit("a"), (F.col("o_custkey") % 20).cast("string"))
    pulls = read(spark, sf_dir, "orders").select(
        person.alias("author"), person.alias("pr_author"), F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("reviewer"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("review_state")
    )
    every = [h for hs in compare.HINTS.values() for h in hs]
    return rounded(compare.evaluate_hints(every, table_nodes(pulls).select("path").distinct(), relations.discover(pulls)))


@register(
    """SELECT event_id AS record_id, 'npm' AS manifest, f AS finding, s AS severity, n::BIGINT AS count FROM events, (VALUES ('npm_dependency_count', 'info', 1), ('npm_missing_provenance', 'notable', 0)) t(f, s, n) WHERE event_id % 2 = 0
       UNION ALL SELECT event_id, 'npm', f, s, 1 FROM events, (VALUES ('npm_install_hook', 'concern'), ('npm_script_count', 'info')) t(f, s) WHERE event_id % 6 = 0"""
)
def structural_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    scripts = F.when(e % 6 == 0, ',"scripts":{"postinstall":"x"}').otherwise("")
    body = F.when(e % 2 == 0, F.concat(F.lit('{"name":"p","version":"1","dependencies":{"a":"1"}'), scripts, F.lit("}"))).otherwise('{"name":"p"}')
    return compare.structural_findings(json_nodes(read(spark, sf_dir, "events").select("event_id", body.alias("b")), "event_id", "b"))


@register(
    """WITH RECURSIVE p AS (SELECT DISTINCT event_type AS g, json_structure(props)::VARCHAR AS s FROM events),
       r AS (SELECT g AS a, g AS b FROM p UNION SELECT r.a, q.g FROM r JOIN p o ON o.g = r.b JOIN p q ON q.s = o.s), l AS (SELECT a AS g, min(b) AS cluster FROM r GROUP BY a)
       SELECT g, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM l"""
)
def corpus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    shapes = fingerprints.merkle_shapes(events, "event_id", "props").join(events.select("event_id", "event_type"), "event_id")
    return compare.corpus_clusters(shapes, "event_type")


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents of all kinds: an object, an array with objects, an object with lists, an array without objects or no JSON."""
    props, k = F.col("props"), F.col("event_id") % 4
    body = (
        F.when(k == 0, props)
        .when(k == 1, F.concat(F.lit("["), props, F.lit(',5,"{x",'), props, F.lit(",[1]]")))
        .when(k == 2, F.concat(F.lit('{"z":[{"k":1}],"list":[3,'), props, F.lit('],"a":[1,2]}')))
        .when(F.col("user_id") % 2 == 0, F.lit("[1,2]"))
        .otherwise(F.lit("no json"))
    )
    return read(spark, sf_dir, "events").select("event_id", body.alias("body"))


@register(
    """SELECT event_id % 4 AS kind, (CASE event_id % 4 WHEN 1 THEN n // 2 ELSE 0 END) AS pos, count(*) AS records, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total
       FROM events, (VALUES (0), (2)) v(n) WHERE event_id % 4 <> 3 AND (event_id % 4 = 1 OR n = 0) GROUP BY ALL"""
)
def record_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.extract_records(_record_texts(spark, sf_dir), "event_id", "body")
    return found.groupBy((F.col("event_id") % 4).alias("kind"), "pos").agg(F.count("*").alias("records"), F.sum(F.try_variant_get(records.select_field(F.col("record"), "$.k"), "$", "long")).alias("total"))


@register(
    """SELECT event_type AS indexed, CAST(user_id % 5 AS VARCHAR) AS dotted, '[10,{"c":"' || event_type || '"}]' AS container, NULL::VARCHAR AS grouped_container,
       CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, NULL::VARCHAR AS missing, count(*) AS n FROM events GROUP BY ALL"""
)
def field_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"a":{"b":[10,{"c":"'), F.col("event_type"), F.lit('"}],"d":'), (F.col("user_id") % 5).cast("string"), F.lit('},"s":'), flag, F.lit(',"n":null}'))
    r = F.col("record")
    found = records.extract_records(read(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body")
    cells = found.select(
        F.try_variant_get(records.select_field(r, "$.a.b[1].c"), "$", "string").alias("indexed"),
        records.field_text(r, "$.a.d").alias("dotted"),
        records.field_text(r, "a.b").alias("container"),
        records.field_text(r, "a.b", containers=False).alias("grouped_container"),
        records.field_text(r, "s", containers=False).alias("flag"),
        records.field_text(r, "$.n").alias("missing"),
    )
    return cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))


@register(
    """WITH c AS (SELECT event_type AS trigger, lead(event_type) OVER w AS response, user_id AS a, lead(user_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY ts, event_id)),
       f AS (SELECT * FROM c WHERE trigger NOT LIKE '%error%' AND response LIKE '%error%')
       SELECT (SELECT count(*) FROM events) AS total_events, count(*) AS cascades, round(count(*) / (SELECT count(*) FROM events), 6) AS cascade_rate, round(count(*) FILTER (a = b) / count(*), 6) AS self_fix_rate FROM f"""
)
def self_fix_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 50)
    found = temporal.cascades(events, "part", ["ts", "event_id"], "event_type", ["error"], keep=["user_id"])
    return rounded(temporal.cascade_summary(events, found, "part", "user_id"))


@register(
    """WITH s AS (SELECT user_id % 20 AS part, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS step FROM events)
       SELECT part, count(*) AS events, coalesce(bool_and(step > 0), true) AS is_monotonic FROM s GROUP BY part"""
)
def monotonic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.monotonic(read(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 20), ["part"], ["event_id"], "ts")


def _sql_category(feature: str) -> str:
    return f"""
    SELECT '{feature}' AS feature, CASE WHEN t >= f THEN '==' ELSE '!=' END AS rule, v AS value, round(CASE WHEN t >= f THEN t ELSE 1 - t END, 6) + 0.0 AS tpr, round(CASE WHEN t >= f THEN f ELSE 1 - f END, 6) + 0.0 AS fpr, round(abs(t - f), 6) AS youden_j,
           round(CASE WHEN t >= f THEN t * 0.1 / (t * 0.1 + f * 0.9) ELSE (1 - t) * 0.1 / ((1 - t) * 0.1 + (1 - f) * 0.9) END, 6) AS precision_at_base_rate
    FROM (SELECT v, a / sum(a) OVER () AS t, b / sum(b) OVER () AS f FROM (SELECT coalesce({feature}, '(absent)') AS v, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality <> 1) AS b FROM {_LABELLED} WHERE quality IS NOT NULL GROUP BY 1))
    ORDER BY abs(t - f) DESC, v LIMIT 1"""


@register(" UNION ALL ".join(f"SELECT * FROM ({_sql_category(f)})" for f in ("lang", "source")))
def operating_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(separation.operating_category(_labelled(spark, sf_dir), "quality", "1", ["lang", "source"], base_rate=0.1))


@register(
    """WITH e AS (SELECT event_id, value, CASE WHEN event_id % 500 = 0 THEN 'rare ' || (event_id % 7) ELSE event_type END AS kind, CASE WHEN user_id % 7 = 1 THEN NULL ELSE user_id END AS v FROM events),
       x AS (SELECT event_id, '$[*].value' AS path, value AS num FROM e UNION ALL SELECT event_id, '$[*].v', v::DOUBLE FROM e WHERE v IS NOT NULL),
       c AS (SELECT path, median(num) AS m, mad(num) AS d FROM x GROUP BY path),
       k AS (SELECT kind, count(*) AS n FROM e GROUP BY kind), b AS (SELECT kind, log2((SELECT sum(n) FROM k)) - log2(n) AS bits FROM k), mb AS (SELECT avg(bits) AS mean FROM b), db AS (SELECT median(abs(bits - mean)) AS mad FROM b, mb)
       SELECT 'numeric_outlier' AS kind, path, event_id AS record_id, NULL::VARCHAR AS value, round(num, 6) AS num, round(0.6745 * (num - m) / d, 6) AS score FROM x JOIN c USING (path) WHERE abs(0.6745 * (num - m) / d) > 3.5
       UNION ALL SELECT 'rare_value', '$[*].kind', NULL, kind, NULL, round(bits, 6) FROM b, mb, db WHERE mad > 2.3e-16 AND bits > mean + 2.0 * mad
       UNION ALL SELECT 'type_instability', '$[*].v', NULL, CASE WHEN count(v) * 2 >= count(*) THEN 'integer' ELSE 'null' END, NULL, round(1 - greatest(count(v), count(*) - count(v)) / count(*), 6) FROM e"""
)
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 500 == 0, F.concat(F.lit("rare "), (F.col("event_id") % 7).cast("string"))).otherwise(F.col("event_type"))
    v = F.when(F.col("user_id") % 7 != 1, F.col("user_id"))
    table = read(spark, sf_dir, "events").select("event_id", "value", kind.alias("kind"), v.alias("v"))
    return rounded(anomalies.anomaly_report(table_nodes(table, ["value", "kind", "v"], F.col("event_id"))))


@register(
    """WITH c AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS z, count(*) FILTER (event_id % 3 = 1) AS i, count(*) FILTER (event_id % 3 = 2) AS s FROM events GROUP BY user_id)
       SELECT user_id AS record_id, 2 * (z + i + s) AS nodes, sha256('$[*]:object' || chr(1) || '$[*].v:' || CASE WHEN s >= i AND s >= z THEN 'string' WHEN i >= z THEN 'integer' ELSE 'null' END) AS typed_path FROM c"""
)
def typed_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, "null").when(F.col("event_id") % 3 == 1, "7").otherwise('"x"')
    texts = read(spark, sf_dir, "events").select("user_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("body"))
    return fingerprints.shape_fingerprints(json_nodes(texts, "user_id", "body", root="$[*]")).select("record_id", "nodes", "typed_path")
