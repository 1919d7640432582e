"""Registered queries: filters, markers, order, seeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import EVENT_LINES, event_fields, events, query, sql, then
from lumberline.functions.rules import Rule, rules_from_json
from lumberline.operators import filters, marks, order
from lumberline.operators.filters import FilterSpec

S = SparkSession
KEY = ["file_path", "line_no"]
_KEY = "SELECT file_path, line_no FROM lines WHERE "
_FROM, _TO = "2024-01-20 00:00:00", "2024-02-20 12:30:00"
_FROM_MS, _TO_MS = filters.to_ms(_FROM), filters.to_ms(_TO)


def _kept(view: DataFrame) -> DataFrame:
    return view.select(*KEY)


@query("F1_levels", sql(_KEY + "level IN (5, 6)"))
def by_level(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_levels(events(spark, sf_dir), ["ERROR", "fatal"]))


@query("F2_time", sql(_KEY + f"ts_ms >= {_FROM_MS} AND ts_ms <= {_TO_MS}"))
def by_time(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_time(events(spark, sf_dir), _FROM, _TO))


@query("F2_time_end_only", sql(_KEY + f"ts_ms IS NULL OR ts_ms <= {_TO_MS}"))
def by_end(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_time(events(spark, sf_dir), None, _TO))


@query("F3_covering_range", sql("SELECT file_path, line_no FROM lines"))
def covering(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_time(events(spark, sf_dir), "2024-01-01 00:00:00", "2025-01-01 00:00:00", picked=True))


@query("F4_substring", sql(_KEY + "contains(lower(text), 'user 8 ')"))
def substring(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_rules(events(spark, sf_dir), [Rule("USER 8 ")]))


@query("F5_regex", sql(_KEY + r"regexp_matches(text, 'value=\d{3}\.')"))
def regex(spark: S, sf_dir: str) -> DataFrame:
    rules = [Rule(r"value=\d{3}\.", regex=True, case_sensitive=True), Rule("([", regex=True)]
    return _kept(filters.filter_rules(events(spark, sf_dir), rules))


@query("F6_exclude", sql(_KEY + "NOT contains(text, 'INFO')"))
def exclude(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.filter_rules(events(spark, sf_dir), [Rule("INFO", action="exclude", case_sensitive=True)]))


@query("F7_field_rule", sql("""SELECT l.file_path, l.line_no FROM lines l LEFT JOIN st ON l.file_path = st.f AND l.seq = st.event_id * 4
  WHERE NOT coalesce(contains(st.event_type, 'click'), false) AND NOT contains(lower(l.text), 'user 1')"""))
def field_rule(spark: S, sf_dir: str) -> DataFrame:
    rules = [Rule("click", field="Kind", action="exclude"), Rule("user 1", field="No such field", action="exclude")]
    return _kept(filters.filter_rules(event_fields(spark, sf_dir), rules, field_scope=True))


@query("F8_rule_groups", sql(_KEY + """(contains(lower(text), 'error') AND contains(lower(text), 'user 3'))
  OR (contains(text, 'DEBUG') AND NOT contains(lower(text), 'user 4'))"""))
def rule_groups(spark: S, sf_dir: str) -> DataFrame:
    rules = rules_from_json("""{"rules": [
      {"text": "error"}, {"text": "off", "connector": "or", "enabled": false}, {"text": "user 3"},
      {"text": "DEBUG", "connector": "or", "caseSensitive": true}, {"text": "([", "regex": true, "connector": "or"},
      {"text": "user 4", "action": "exclude"}]}""")
    return _kept(filters.filter_rules(events(spark, sf_dir), rules))


_SPEC = FilterSpec(levels=["WARN", "ERROR", "FATAL"], start=_FROM, end=_TO,
                   rules=[Rule("user 1"), Rule("at app", connector="or")])
_SPEC_SQL = f"""level IN (4, 5, 6) AND ts_ms BETWEEN {_FROM_MS} AND {_TO_MS}
  AND (contains(lower(text), 'user 1') OR contains(lower(text), 'at app'))"""


@query("F9_all_filters", sql(_KEY + _SPEC_SQL))
def all_filters(spark: S, sf_dir: str) -> DataFrame:
    return _kept(filters.apply_filters(events(spark, sf_dir), _SPEC))


@query("F10_search", sql("""SELECT file_path, line_no, n AS row_no FROM (
  SELECT *, row_number() OVER (ORDER BY ts_ms NULLS LAST, file_path, logical_id, line_no) - 1 AS n FROM lines WHERE level >= 4)
  WHERE contains(lower(text), 'user 7')"""))
def search(spark: S, sf_dir: str) -> DataFrame:
    view = filters.filter_levels(events(spark, sf_dir), ["WARN", "ERROR", "FATAL"])
    return filters.search(view, [Rule("user 7")]).select(*KEY, "row_no")


_PATTERNS = [Rule("user 8", color="red"), Rule(r"k\": \d\d", regex=True, color="blue"), Rule("event", color="green"), Rule("([", regex=True, color="x")]


@query("M1_markers", sql(r"""SELECT file_path, line_no, CASE WHEN contains(lower(text), 'user 8') THEN 'red'
  WHEN regexp_matches(text, '(?i)k": \d\d') THEN 'blue' WHEN contains(lower(text), 'event') THEN 'green' END AS marker FROM lines"""))
def markers(spark: S, sf_dir: str) -> DataFrame:
    return marks.mark_rows(events(spark, sf_dir), _PATTERNS).select(*KEY, "marker")


@query("M2_spans", sql("""SELECT file_path, line_no, p AS pattern, CAST(list_sum(list_transform(a[1:k], lambda x: length(x))) + (k - 1) * w AS INTEGER) AS start,
  CAST(w AS INTEGER) AS length FROM (
    SELECT file_path, line_no, p, w, a, unnest(range(1, len(a))) AS k FROM (
      SELECT file_path, line_no, 0 AS p, 2 AS w, string_split(text, 'er') AS a FROM lines
      UNION ALL SELECT file_path, line_no, 1, 5, string_split(lower(text), 'event') FROM lines))"""))
def spans(spark: S, sf_dir: str) -> DataFrame:
    return marks.match_spans(events(spark, sf_dir), [Rule("er", case_sensitive=True), Rule("EVENT")])


_MARKED = "marked AS (SELECT file_path, line_no, replace(text, '=', chr(64976) || '=' || chr(64977)) AS text FROM lines)"


@query("M2_marked_spans", sql("""SELECT file_path, line_no, p AS pattern, CAST(list_sum(list_transform(a[1:k], lambda x: length(x))) + (k - 1) * w AS INTEGER) AS start,
  CAST(w AS INTEGER) AS length FROM (
    SELECT file_path, line_no, p, w, a, unnest(range(1, len(a))) AS k FROM (
      SELECT file_path, line_no, 0 AS p, 2 AS w, string_split(text, 'er') AS a FROM marked
      UNION ALL SELECT file_path, line_no, 1, 2, string_split(text, '=' || chr(64977)) FROM marked))""", then(EVENT_LINES, _MARKED)))
def marked_spans(spark: S, sf_dir: str) -> DataFrame:
    """Lines that hold the characters matching works with, and a pattern that names one of them."""
    lines = events(spark, sf_dir).withColumn("text", F.replace("text", F.lit("="), F.lit("\ufdd0=\ufdd1")))
    return marks.match_spans(lines, [Rule("er", case_sensitive=True), Rule("=\ufdd1", case_sensitive=True)])


@query("M3_match_counts", sql("""SELECT 0 AS pattern, 'er' AS text, count(*) FILTER (WHERE contains(text, 'er')) AS lines,
    CAST(sum((length(text) - length(replace(text, 'er', ''))) / 2) AS BIGINT) AS matches FROM lines
  UNION ALL SELECT 1, 'EVENT', count(*) FILTER (WHERE contains(lower(text), 'event')),
    CAST(sum((length(text) - length(replace(lower(text), 'event', ''))) / 5) AS BIGINT) FROM lines"""))
def match_counts(spark: S, sf_dir: str) -> DataFrame:
    return marks.match_counts(events(spark, sf_dir), [Rule("er", case_sensitive=True), Rule("EVENT")])


@query("O1_order", sql("SELECT file_path, line_no, ts_ms FROM lines ORDER BY ts_ms NULLS LAST, file_path, logical_id, line_no"))
def in_order(spark: S, sf_dir: str) -> DataFrame:
    return order.ordered(events(spark, sf_dir)).select(*KEY, "ts_ms")


@query("O2_row_numbers", sql("SELECT file_path, line_no, row_no FROM placed"))
def row_numbers(spark: S, sf_dir: str) -> DataFrame:
    return order.with_row_no(events(spark, sf_dir)).select(*KEY, "row_no")


# One probe per user: the middle between the user's first and last event.
_PROBES = "probes AS (SELECT user_id AS probe, (min(ms) + max(ms)) // 2 + 40000000 * (user_id % 40) AS \"at\" FROM hd GROUP BY user_id)"


def _probes(spark: S, sf_dir: str) -> DataFrame:
    user = F.regexp_extract("text", r"user (\d+) value", 1).try_cast("bigint")
    span = events(spark, sf_dir).where("is_primary").groupBy(user.alias("probe")).agg(
        F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    return span.select("probe", (F.floor((F.col("lo") + F.col("hi")) / 2) + 40_000_000 * (F.col("probe") % 40)).alias("at"))


@query("O3_seek_time", sql("""SELECT probe, "at", ts_ms, file_path, logical_id, line_no FROM (
  SELECT p.probe, p."at", l.*, row_number() OVER (PARTITION BY p.probe ORDER BY l.row_no) AS k
  FROM probes p JOIN placed l ON l.ts_ms >= p."at" OR l.ts_ms IS NULL) WHERE k = 1""", then(EVENT_LINES, _PROBES)))
def seek_time(spark: S, sf_dir: str) -> DataFrame:
    return order.seek_time(events(spark, sf_dir), _probes(spark, sf_dir))


@query("O4_seek_error", sql("""SELECT probe, "at", ts_ms, file_path, logical_id, line_no FROM (
    SELECT r.probe, r."at", l.*, row_number() OVER (PARTITION BY r.probe ORDER BY
      CASE WHEN l.row_no = r.row THEN 0 ELSE 1 END, abs(l.ts_ms - r."at"), CASE WHEN l.row_no <= r.row THEN 0 ELSE 1 END,
      CASE WHEN l.row_no <= r.row THEN -l.row_no ELSE l.row_no END) AS k
    FROM rows_by_time r JOIN placed l ON l.level >= 4 AND l.ts_ms IS NOT NULL) WHERE k = 1""",
  then(EVENT_LINES, _PROBES, """rows_by_time AS (SELECT p.probe, p."at", min(l.row_no) AS row FROM probes p
    JOIN placed l ON l.ts_ms >= p."at" OR l.ts_ms IS NULL GROUP BY p.probe, p."at")""")))
def seek_error(spark: S, sf_dir: str) -> DataFrame:
    return order.seek_error(events(spark, sf_dir), _probes(spark, sf_dir))


@query("O5_find_next", sql("""SELECT min(row_no) AS row_no FROM placed WHERE row_no > 5000 AND contains(lower(text), 'user 8 ')"""))
def find_next(spark: S, sf_dir: str) -> DataFrame:
    return order.find_next(events(spark, sf_dir), "User 8 ", 5000)


@query("O6_find_previous", sql("""SELECT max(row_no) AS row_no FROM placed WHERE row_no < 5000 AND contains(lower(text), 'user 8 ')"""))
def find_previous(spark: S, sf_dir: str) -> DataFrame:
    return order.find_previous(events(spark, sf_dir), "User 8 ", 5000)


@query("O7_sample", sql("SELECT text FROM placed WHERE trim(text) <> '' ORDER BY row_no LIMIT 50"))
def sample(spark: S, sf_dir: str) -> DataFrame:
    return order.sample_lines(events(spark, sf_dir), 50).select("text")


@query("O8_time_range", sql("SELECT min(ts_ms) AS from_ms, max(ts_ms) AS to_ms FROM lines"))
def time_range(spark: S, sf_dir: str) -> DataFrame:
    return order.time_range(events(spark, sf_dir))


@query("O9_locate_records", sql("""SELECT probe, file_path, line_no FROM (
    SELECT r.probe, l.file_path, l.line_no, row_number() OVER (PARTITION BY r.probe ORDER BY
      CASE WHEN l.row_no >= r.row THEN 0 ELSE 1 END, abs(l.row_no - r.row)) AS k
    FROM firsts r JOIN placed l ON l.level = 6) WHERE k = 1""",
  then(EVENT_LINES, """firsts AS (SELECT row_number() OVER (ORDER BY file_path, logical_id) AS probe, row FROM (
    SELECT file_path, logical_id, min(row_no) AS row FROM placed WHERE level = 1 GROUP BY file_path, logical_id))""")))
def locate(spark: S, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    keys = log.where("level = 1").groupBy("file_path", "logical_id").agg(F.lit(1).alias("one"))
    numbered = order.with_row_no(keys.select(
        F.lit(0).cast("bigint").alias("ts_ms"), "file_path", "logical_id", F.lit(0).alias("line_no")))
    keys = numbered.select((F.col("row_no") + 1).alias("probe"), "file_path", "logical_id")
    return order.locate_records(log, F.col("level") == 6, keys)
