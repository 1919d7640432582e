"""Registered queries: text functions, tokens, JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import DOCUMENT_LINES, EVENT_ROWS, NORMALIZE, documents, events, query, sql, stored
from lumberline.functions import text as T
from lumberline.functions.detect import classify
from lumberline.functions.tokens import token_type
from lumberline.operators import payloads, records, tokens
from lumberline.sources import views

S = SparkSession


@query("N1_normalize", "SELECT doc_id, " + NORMALIZE.format("text") + " AS template FROM documents")
def normalize(spark: S, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("template"))


@query("N2_template_display", sql(r"""SELECT file_path, line_no, CASE WHEN regexp_matches(t, '\p{L}\p{L}') THEN regexp_extract(t, '\p{L}\p{L}.*') ELSE t END AS shown
  FROM (SELECT file_path, line_no, """ + NORMALIZE.format("text") + " AS t FROM lines)"))
def display(spark: S, sf_dir: str) -> DataFrame:
    shown = T.template_display(T.normalize(F.col("text")))
    return events(spark, sf_dir).select("file_path", "line_no", shown.alias("shown"))


_DURATION = """CASE WHEN v < 1000 THEN v || ' ms' WHEN v < 60000 THEN (v // 1000) || ' s'
  WHEN v < 3600000 THEN (v // 60000) || ' min ' || lpad(CAST(v // 1000 % 60 AS VARCHAR), 2, '0') || ' s'
  WHEN v < 86400000 THEN (v // 3600000) || ' h ' || lpad(CAST(v // 60000 % 60 AS VARCHAR), 2, '0') || ' min'
  ELSE (v // 86400000) || ' d ' || lpad(CAST(v // 3600000 % 24 AS VARCHAR), 2, '0') || ' h' END"""


@query("N3_duration", f"SELECT o_orderkey, {_DURATION} AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 7) % 400000000 // CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 200 ELSE 100000 END AS v FROM orders)")
def duration(spark: S, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    by = F.when(key % 3 == 0, 1).when(key % 3 == 1, 200).otherwise(100_000)
    orders = views.table(spark, sf_dir, "orders").withColumn("v", F.floor((key * key * 7) % 400_000_000 / by))
    return orders.select("o_orderkey", T.duration_text(F.col("v")).alias("shown"))


@query("N4_range", sql("""SELECT event_id, strftime(make_timestamp(ms * 1000), '%H:%M:%S') || ' – ' ||
  CASE WHEN ms // 86400000 = e // 86400000 THEN strftime(make_timestamp(e * 1000), '%H:%M:%S') ELSE strftime(make_timestamp(e * 1000), '%d.%m %H:%M:%S') END AS shown
  FROM (SELECT event_id, ms, ms + user_id * 600000 AS e FROM hd)""", EVENT_ROWS))
def range_text(spark: S, sf_dir: str) -> DataFrame:
    rows = views.with_busy_hours(views.table(spark, sf_dir, "events"))
    return rows.select("event_id", T.range_text(F.col("log_ms"), F.col("log_ms") + F.col("user_id") * 600_000).alias("shown"))


@query("N5_alerts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN w = 0 AND e = 0 AND f = 0 THEN '—' ELSE
  CASE WHEN w > 0 THEN CAST(w AS VARCHAR) ELSE '' END || '/' || CASE WHEN e > 0 THEN CAST(e AS VARCHAR) ELSE '' END || '/' || CASE WHEN f > 0 THEN CAST(f AS VARCHAR) ELSE '' END END AS shown
  FROM (SELECT *, l_partkey % 3 AS w, l_suppkey % 2 AS e, l_linenumber % 3 AS f FROM lineitem)""")
def alerts(spark: S, sf_dir: str) -> DataFrame:
    shown = T.alert_text(F.col("l_partkey") % 3, F.col("l_suppkey") % 2, F.col("l_linenumber") % 3)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown"))


@query("N6_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS shown FROM documents")
def ellipsis(spark: S, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", T.ellipsis(F.col("text"), 80).alias("shown"))


# The tokens of a rendered event are known from its columns; no tokenizer is needed to count them.
@query("K1_tokens", sql("""SELECT type, token, count(*) AS n FROM (
  SELECT 'timestamp' AS type, stamp AS token FROM st UNION ALL SELECT 'level', lv FROM st UNION ALL SELECT 'string', '"k"' FROM st
  UNION ALL SELECT 'number', CAST(user_id AS VARCHAR) FROM st UNION ALL SELECT 'number', CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) FROM st
  UNION ALL SELECT 'number', regexp_extract(props, '\\d+') FROM st UNION ALL SELECT 'number', CAST(event_id AS VARCHAR) FROM st WHERE event_type = 'error'
  UNION ALL SELECT 'number', CAST(user_id AS VARCHAR) FROM st WHERE event_type = 'error') GROUP BY type, token""", EVENT_ROWS))
def token_counts(spark: S, sf_dir: str) -> DataFrame:
    return tokens.token_counts(events(spark, sf_dir))


# A line with a token of each type per order.
_TYPED = """tk AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS p FROM orders)"""


@query("K1_all_types", sql("""SELECT type, token, count(*) AS n FROM (SELECT 'level' AS type, 'DEBUG' AS token FROM tk
  UNION ALL SELECT 'url', 'http://h' || (k % 7) || '.example/p?x=' || k FROM tk UNION ALL SELECT 'path', '/var/log/a' || (k % 5) || '/f.txt' FROM tk
  UNION ALL SELECT 'string', chr(39) || 'q' || k || chr(39) FROM tk UNION ALL SELECT 'timestamp', '2031-01-05 04:05:06' FROM tk
  UNION ALL SELECT 'guid', '123e4567-e89b-12d3-a456-' || p FROM tk UNION ALL SELECT 'hex', '0x1F' || (k % 9) FROM tk
  UNION ALL SELECT 'ip', '10.0.' || (k % 256) || '.1' FROM tk UNION ALL SELECT 'raw_hex', '7AB' || (k % 10) || 'EF' FROM tk
  UNION ALL SELECT 'number', CAST(k AS VARCHAR) FROM tk) GROUP BY type, token""", _TYPED))
def all_types(spark: S, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.format_string(
        "DEBUG http://h%d.example/p?x=%d /var/log/a%d/f.txt 'q%d' 2031-01-05 04:05:06 123e4567-e89b-12d3-a456-%012d 0x1F%d 10.0.%d.1 7AB%dEF %d",
        k % 7, k, k % 5, k, k, k % 9, k % 256, k % 10, k)
    return tokens.token_counts(views.table(spark, sf_dir, "orders").select(text.alias("text")))


_URL = r"'[A-Za-z][A-Za-z0-9+.\-]*://[^\s<>{}|^]*[^\s<>{}|^,;.)''\"\]]'"


@query("K2_top_urls", rf"SELECT regexp_extract(url, {_URL}) AS token, count(*) AS n FROM pages WHERE regexp_matches(url, {_URL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_urls(spark: S, sf_dir: str) -> DataFrame:
    return tokens.top_tokens(views.table(spark, sf_dir, "pages").select(F.col("url").alias("text")), "url", 100)


@query("K2_top_hosts", r"SELECT regexp_extract(url, '://([^/:?#]+)', 1) AS token, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_hosts(spark: S, sf_dir: str) -> DataFrame:
    return tokens.top_tokens(views.table(spark, sf_dir, "pages").select(F.col("url").alias("text")), "host", 20)


@query("K3_token_type", sql(r"""SELECT file_path, line_no, CASE WHEN v = '' THEN 'none' WHEN regexp_full_match(v, '[a-zA-Z][a-zA-Z0-9+.\-]*://\S+') THEN 'url'
  WHEN regexp_full_match(v, '(\d{4}[-/.]\d{2}[-/.]\d{2}[T ]|\d{2}[-/.]\d{2}[-/.]\d{4} )?\d{1,2}:\d{2}:\d{2}([.,]\d{1,9})?') THEN 'timestamp'
  WHEN contains(v, '/') OR contains(v, '\') THEN 'path' ELSE 'none' END AS kind FROM (SELECT file_path, line_no,
  CASE line_no % 3 WHEN 0 THEN substr(text, 1, 23) WHEN 1 THEN file_path ELSE 'log:/' || file_path END AS v FROM lines)"""))
def kinds(spark: S, sf_dir: str) -> DataFrame:
    value = F.when(F.col("line_no") % 3 == 0, F.left("text", F.lit(23))).when(
        F.col("line_no") % 3 == 1, F.col("file_path")).otherwise(F.concat(F.lit("log:/"), F.col("file_path")))
    return events(spark, sf_dir).select("file_path", "line_no", token_type(value).alias("kind"))


@query("J1_json_blocks", sql("SELECT l.file_path, l.line_no AS first_line, 0 AS block_no, st.props AS json FROM lines l JOIN st ON l.file_path = st.f AND l.seq = st.event_id * 4"))
def json_blocks(spark: S, sf_dir: str) -> DataFrame:
    return payloads.line_json_blocks(events(spark, sf_dir))


_DUMPED = r"""
od AS (SELECT '/dumps/orders' || (o_custkey % 2) || '.log' AS file_path, o_orderkey, o_orderstatus AS s,
  CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS price, chr(10) AS nl FROM orders WHERE o_orderstatus <> 'P'),
js AS (SELECT file_path, o_orderkey, '[' || price || ',' || nl || '    2]' AS prices, s, nl FROM od),
found AS (SELECT file_path, o_orderkey, CASE WHEN s = 'F' THEN prices ELSE
  '{' || nl || '  "key": ' || o_orderkey || ',' || nl || '  "status": "' || s || '", "note": "} ] \" {",' || nl || '  "prices": ' || prices || nl || '}' END AS json FROM js)"""


@query("J1_json_over_blocks", sql("""SELECT file_path, CAST(1 AS BIGINT) AS first_line,
  CAST(row_number() OVER (PARTITION BY file_path ORDER BY o_orderkey) - 1 AS INTEGER) AS block_no, json FROM found""", _DUMPED))
def json_over_blocks(spark: S, sf_dir: str) -> DataFrame:
    build = lambda s, d: records.assign_records(classify(views.json_dump_lines(s, d, 1021)))
    return payloads.line_json_blocks(stored(spark, sf_dir, "json-dump", build))


@query("J2_json_keys", r"SELECT 'k' AS key, count(*) AS objects, count(DISTINCT regexp_extract(props, '\d+')) AS distinct_values FROM events")
def json_keys(spark: S, sf_dir: str) -> DataFrame:
    return payloads.json_keys(payloads.line_json_blocks(events(spark, sf_dir)))


@query("L9_plain_records", sql("SELECT file_path, logical_id, line_no AS first_line, CAST(1 AS BIGINT) AS n_lines, ts_ms, level, text, false AS truncated FROM lines", DOCUMENT_LINES))
def plain_records(spark: S, sf_dir: str) -> DataFrame:
    return records.assemble_records(documents(spark, sf_dir), max_lines=None, max_chars=None)

