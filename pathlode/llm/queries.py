"""The registered queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.llm import chat, decontam, html_text, language, line_dedup, mixing, near_dup, quality, sharding, urls

# The rules of the URL query, and hosts listed for its method.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.chat_digests(chat.format_chats(chat.turns_as_events(rows.unionByName(added))))


def url_entries(spark: SparkSession) -> DataFrame:
    rules = [(h, p, v, "rule", 1) for h, p, v in URL_RULES]
    listed = [(f"{n}.{d}", "/", "block", "listed", 0) for n in LISTED_NAMES for d in LISTED_DOMAINS]
    rows = ", ".join(f"('{h}', '{p}', '{v}', '{k}', {r})" for h, p, v, k, r in rules + listed)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict, kind, rank)")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_entries(spark))
    return judged.select("page_id", "host", "path", F.when(F.col("entry_kind") == "rule", F.col("entry")).alias("rule"), "verdict")


def _sql_op2() -> str:
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))]
    by_rule = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"{w} THEN '{h}{p}'" for w, (h, p, _) in zip(fits, by_rule, strict=True))
    verdict = " ".join(f"{w} THEN '{v}'" for w, (_, _, v) in zip(fits, by_rule, strict=True))
    listed = " OR ".join(f"((host = '{n}.{d}' OR host LIKE '%.{n}.{d}') AND starts_with(path, '/'))" for n in LISTED_NAMES for d in LISTED_DOMAINS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH split AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
        FROM split"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model, extra={"held_out": language.held_out(F.col("doc_id"))})
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_chat": op1_chat, "op2_urls": op2_urls, "op3_near_dup": op3_near_dup, "op4_sharding": op4_sharding, "op5_decontamination": op5_decontamination, "op6_language": op6_language, "op7_line_dedup": op7_line_dedup, "op8_mixing": op8_mixing, "op9_quality": op9_quality, "op10_html": op10_html}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _SQL_OP1, "op2_urls": _sql_op2(), "op5_decontamination": _SQL_OP5}


_SQL_OP1 = r"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    conv AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
               coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss_text,
               sum(length(role) + length(text) + 4 + 2 + 8
                   + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
                   + (length(text) - length(replace(text, '</turn>', ''))) // 7
                   + (length(role) - length(replace(role, '</turn>', ''))) // 7
                   + list_sum([0] || list_transform(regexp_extract_all(text, '##+'), lambda x: greatest(length(x) - 2, 0)))
                   + list_sum([0] || list_transform(regexp_extract_all(role, '##+'), lambda x: greatest(length(x) - 2, 0)))
                   + (length(text) - length(replace(text, ':' || chr(10), ''))) // 2
                   + (length(role) - length(replace(role, ':' || chr(10), ''))) // 2) AS formatted_chars
        FROM said GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text) AS loss_chars,
           sha256(loss_text) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
    FROM conv"""

_SQL_OP5 = r"""
    WITH texts AS (
        SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    tokens AS (
        SELECT kind, id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM texts),
    shingles AS (
        SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
        FROM tokens WHERE len(w) > 0),
    sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id),
    both_have AS (
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n
        FROM shingles d JOIN shingles i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
    SELECT doc_id, item_id, b.n AS n_found, s.n AS n_item, b.n / s.n AS containment
    FROM both_have b JOIN sizes s ON b.item_id = s.id WHERE 100 * b.n >= 75 * s.n"""
