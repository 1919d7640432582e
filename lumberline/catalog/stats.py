"""Registered queries: statistics, timeline, insights, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import BLOCK, EVENT_LINES, NORMALIZE, documents, DOCUMENT_LINES, events, query, sql, then
from lumberline.functions.detect import classify
from lumberline.operators import directory, documents as docs, insights, stats
from lumberline.sources import views

S = SparkSession

_SPAN = """
span AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi, count(ts_ms) AS n FROM heads),
wide AS (SELECT *, (hi - lo) / 720.0::DOUBLE AS w FROM span),
b AS (SELECT CAST(least(719, floor((ts_ms - lo) / w)) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE level >= 5) AS errors
  FROM heads, wide WHERE ts_ms IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(r AS INTEGER) AS bin, coalesce(b.n, 0) AS n, coalesce(errors, 0) AS errors FROM range(720) t(r) LEFT JOIN b ON b.bin = r)"""
BINNED = then(EVENT_LINES, _SPAN)


def _at(bin_no: str) -> str:
    return f"(lo + CAST(trunc(({bin_no}) * w) AS BIGINT))"


@query("A1_totals", sql("SELECT (SELECT count(*) FROM lines) AS lines, count(*) AS records, count(ts_ms) AS records_with_ts FROM heads"))
def totals(spark: S, sf_dir: str) -> DataFrame:
    return stats.totals(events(spark, sf_dir))


@query("A1_totals_plain", sql("SELECT count(*) AS lines, count(*) AS records, CAST(0 AS BIGINT) AS records_with_ts FROM lines", DOCUMENT_LINES))
def totals_plain(spark: S, sf_dir: str) -> DataFrame:
    return stats.totals(documents(spark, sf_dir))


@query("A3_levels", sql("""SELECT level, CASE level WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'TRACE' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO'
  WHEN 4 THEN 'WARN' WHEN 5 THEN 'ERROR' ELSE 'FATAL' END AS level_name, count(*) AS records,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM heads), 6) AS share FROM heads GROUP BY level"""))
def levels(spark: S, sf_dir: str) -> DataFrame:
    return stats.level_counts(events(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("A4_rates", sql("""SELECT lo AS from_ms, hi AS to_ms, n AS records_with_ts, hi - lo AS span_ms,
  round(n * 1000.0::DOUBLE / (hi - lo), 9) AS avg_per_sec FROM span""", BINNED))
def rates(spark: S, sf_dir: str) -> DataFrame:
    return stats.rates(events(spark, sf_dir)).withColumn("avg_per_sec", F.round("avg_per_sec", 9))


@query("A5_peak_rate", sql(f"""SELECT bin, round(bins.n * 1000.0::DOUBLE / w, 9) AS peak_per_sec, {_at('bin')} AS peak_from_ms,
  {_at('bin + 1')} AS peak_to_ms FROM bins, wide ORDER BY bins.n DESC, bin LIMIT 1""", BINNED))
def peak(spark: S, sf_dir: str) -> DataFrame:
    return stats.peak_rate(events(spark, sf_dir)).withColumn("peak_per_sec", F.round("peak_per_sec", 9))


_ORDER = "row(ts_ms IS NULL, coalesce(ts_ms, 0), file_path, logical_id, line_no)"
_TEMPLATES = f"""
tpl AS (SELECT {NORMALIZE.format('text')} AS template, count(*) AS records, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
  arg_min(level, {_ORDER}) AS level, arg_min(text, {_ORDER}) AS example,
  arg_min(file_path, {_ORDER}) AS first_file, arg_min(logical_id, {_ORDER}) AS first_entry FROM heads GROUP BY 1)"""
TEMPLATED = then(EVENT_LINES, _TEMPLATES)


@query("A6_templates", sql("SELECT * FROM tpl", TEMPLATED))
def templates(spark: S, sf_dir: str) -> DataFrame:
    return stats.templates(events(spark, sf_dir))


@query("A6_templates_plain", sql("SELECT template, records, example FROM tpl", then(DOCUMENT_LINES, _TEMPLATES)))
def templates_plain(spark: S, sf_dir: str) -> DataFrame:
    return stats.templates(documents(spark, sf_dir)).select("template", "records", "example")


_SHARE = "round(records / (SELECT count(*) FROM heads)::DOUBLE, 9) AS share"


@query("A7_top_messages", sql(f"SELECT *, {_SHARE} FROM tpl ORDER BY records DESC, template LIMIT 10", TEMPLATED))
def top_messages(spark: S, sf_dir: str) -> DataFrame:
    return stats.top_messages(events(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("A7_top_errors", sql(f"SELECT *, {_SHARE} FROM tpl WHERE level >= 5 ORDER BY records DESC, template LIMIT 5", TEMPLATED))
def top_errors(spark: S, sf_dir: str) -> DataFrame:
    return stats.top_errors(events(spark, sf_dir)).withColumn("share", F.round("share", 9))


_FILES = """SELECT file_path, count(*) FILTER (WHERE h) AS records, count(*) AS lines, count(*) FILTER (WHERE h AND level = 4) AS warn,
  count(*) FILTER (WHERE h AND level = 5) AS error, count(*) FILTER (WHERE h AND level = 6) AS fatal, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
  FROM (SELECT *, is_primary OR is_plain AS h FROM lines) GROUP BY file_path"""


@query("A8_files", sql(_FILES))
def by_file(spark: S, sf_dir: str) -> DataFrame:
    return stats.file_breakdown(events(spark, sf_dir))


@query("A8_files_filtered", sql("""SELECT file_path, count(DISTINCT logical_id) AS records, count(*) AS lines,
  count(DISTINCT CASE WHEN level = 4 THEN logical_id END) AS warn, count(DISTINCT CASE WHEN level = 5 THEN logical_id END) AS error,
  count(DISTINCT CASE WHEN level = 6 THEN logical_id END) AS fatal, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
  FROM lines WHERE level >= 4 AND (contains(text, 'Events') OR contains(text, 'failed') OR contains(text, 'user 1')) GROUP BY file_path"""))
def by_file_filtered(spark: S, sf_dir: str) -> DataFrame:
    text = F.col("text")
    view = events(spark, sf_dir).where((F.col("level") >= 4) & (text.contains("Events") | text.contains("failed") | text.contains("user 1")))
    return stats.file_breakdown(view, filtered=True)


@query("A9_bins", sql("SELECT bin, n, errors FROM bins", BINNED))
def bins(spark: S, sf_dir: str) -> DataFrame:
    return stats.bins720(events(spark, sf_dir)).select("bin", "n", "errors")


def _timeline_sql(lo: str = "lo", hi: str = "hi") -> str:
    return f"""
lim AS (SELECT {lo} AS tlo, {hi} AS thi FROM span),
tl AS (SELECT CAST(least(4095, (ts_ms - tlo) * 4096 // greatest(1, thi - tlo)) AS INTEGER) AS bin, count(*) AS total,
  count(*) FILTER (WHERE level = 4) AS warn, count(*) FILTER (WHERE level = 5) AS error, count(*) FILTER (WHERE level = 6) AS fatal
  FROM heads, lim WHERE ts_ms IS NOT NULL GROUP BY 1)"""


TIMED = then(BINNED, _timeline_sql())


@query("A10_timeline", sql("SELECT * FROM tl", TIMED))
def timeline(spark: S, sf_dir: str) -> DataFrame:
    return stats.timeline(events(spark, sf_dir))


@query("A10_timeline_widened", sql("SELECT * FROM tl", then(BINNED, _timeline_sql("least(lo, 1704000000000)", "greatest(hi, 1715000000000)"))))
def timeline_widened(spark: S, sf_dir: str) -> DataFrame:
    return stats.timeline(events(spark, sf_dir), from_ms=1_704_000_000_000, to_ms=1_715_000_000_000)


@query("A11_cumulative", sql("""SELECT CAST(r AS INTEGER) AS bin, CAST(sum(coalesce(total, 0)) OVER w AS BIGINT) AS total_to, CAST(sum(coalesce(warn, 0)) OVER w AS BIGINT) AS warn_to,
  CAST(sum(coalesce(error, 0)) OVER w AS BIGINT) AS error_to, CAST(sum(coalesce(fatal, 0)) OVER w AS BIGINT) AS fatal_to
  FROM range(4096) t(r) LEFT JOIN tl ON tl.bin = r WINDOW w AS (ORDER BY r)""", TIMED))
def cumulative(spark: S, sf_dir: str) -> DataFrame:
    return stats.timeline_cumulative(stats.timeline(events(spark, sf_dir)))


@query("A11_range_counts", sql("""SELECT count(*) AS total, count(*) FILTER (WHERE level = 4) AS warn, count(*) FILTER (WHERE level = 5) AS error,
  count(*) FILTER (WHERE level = 6) AS fatal FROM heads, lim WHERE least(4095, (ts_ms - tlo) * 4096 // greatest(1, thi - tlo)) BETWEEN 300 AND 3000""", TIMED))
def range_counts(spark: S, sf_dir: str) -> DataFrame:
    return stats.range_counts(stats.timeline_cumulative(stats.timeline(events(spark, sf_dir))), 300, 3000)


@query("A12_columns", sql("""SELECT x, total, warn, error, fatal, max(total) OVER () AS max_total, max(warn + error + fatal) OVER () AS max_alerts FROM (
  SELECT CAST(c AS INTEGER) AS x, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(warn), 0) AS BIGINT) AS warn, CAST(coalesce(sum(error), 0) AS BIGINT) AS error,
    CAST(coalesce(sum(fatal), 0) AS BIGINT) AS fatal FROM range(900) t(c) LEFT JOIN tl ON tl.bin >= c * 4096 // 900 AND tl.bin < greatest((c + 1) * 4096 // 900, c * 4096 // 900 + 1) GROUP BY c)""", TIMED))
def columns(spark: S, sf_dir: str) -> DataFrame:
    return stats.timeline_columns(stats.timeline(events(spark, sf_dir)), 900)


@query("A16_sources", sql("SELECT count(DISTINCT file_path) AS files, count(DISTINCT file_path) > 1 AS badge FROM lines"))
def sources(spark: S, sf_dir: str) -> DataFrame:
    return docs.source_count(events(spark, sf_dir))


# ---- insights ----------------------------------------------------------------------------------

_MEDIAN = """
med AS (SELECT list_sort(list(n::DOUBLE))[361] AS m FROM bins),
rob AS (SELECT m AS median, list_sort(list(abs(n - m)))[361] AS mad FROM bins, med GROUP BY m)"""


def _islands_sql(name: str, value: str, threshold: str, source: str) -> str:
    return f"""
{name}_hi AS (SELECT bin, bins.{value} AS v, bin - row_number() OVER (ORDER BY bin) AS g FROM {source} WHERE bins.{value} > {threshold}),
{name} AS (SELECT min(bin) AS first, max(bin) AS last, CAST(sum(v) AS BIGINT) AS s FROM {name}_hi GROUP BY g)"""


_BURST_RUNS = _islands_sql("br", "n", "greatest(median + 6.0::DOUBLE * 1.4826::DOUBLE * mad, wide.n / 720.0::DOUBLE * 3.0::DOUBLE, 8.0::DOUBLE)", "bins, rob, wide")
_SPIKES = "ex AS (SELECT CAST(sum(errors) AS BIGINT) AS errs, sum(errors) / 720.0::DOUBLE AS e FROM bins)"
_SPIKE_RUNS = _islands_sql("sr", "errors", "greatest(5.0::DOUBLE, e + 6.0::DOUBLE * sqrt(e + 0.5::DOUBLE))", "bins, ex")
_INSIGHTS = f"""
burst AS (SELECT 'Burst' AS kind, {_at('first')} AS from_ms, {_at('last + 1')} AS to_ms, s AS count, s::DOUBLE / (last - first + 1) / greatest(1.0::DOUBLE, median) AS factor,
  NULL::DOUBLE AS share, NULL::VARCHAR AS snippet, s::DOUBLE AS magnitude FROM br, rob, wide WHERE wide.n >= 200 AND s >= 50 ORDER BY s DESC, first LIMIT 2),
spike AS (SELECT 'ErrorSpike' AS kind, {_at('first')} AS from_ms, {_at('last + 1')} AS to_ms, s AS count, s / greatest(1e-9::DOUBLE, e * (last - first + 1)) AS factor,
  NULL::DOUBLE AS share, NULL::VARCHAR AS snippet, s::DOUBLE AS magnitude FROM sr, ex, wide WHERE errs >= 20 ORDER BY s DESC, first LIMIT 2),
tc AS (SELECT {NORMALIZE.format('text')} AS template, count(*) AS records, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM heads GROUP BY 1),
rec AS (SELECT count(*) AS r, count(ts_ms) * 1000.0::DOUBLE / (max(ts_ms) - min(ts_ms)) AS rate FROM heads),
den AS (SELECT *, CASE WHEN last_ms > first_ms THEN records * 1000.0::DOUBLE / (last_ms - first_ms) ELSE 0 END AS d FROM tc, rec),
spam AS (SELECT 'Spam' AS kind, first_ms AS from_ms, last_ms AS to_ms, records AS count, NULL::DOUBLE AS factor, records / r::DOUBLE AS share,
  CASE WHEN regexp_matches(template, '\\p{{L}}\\p{{L}}') THEN regexp_extract(template, '\\p{{L}}\\p{{L}}.*') ELSE template END AS snippet, records::DOUBLE AS magnitude
  FROM den WHERE records >= greatest(100, r // 50) AND (records / r::DOUBLE >= 0.2::DOUBLE OR (d >= 5 AND (rate <= 0 OR d >= 8 * rate))) ORDER BY records DESC, template LIMIT 2),
gp AS (SELECT ts_ms, lag(ts_ms) OVER (ORDER BY ts_ms) AS p FROM heads WHERE ts_ms IS NOT NULL),
g3 AS (SELECT p AS from_ms, ts_ms AS to_ms, ts_ms - p AS g FROM gp WHERE p IS NOT NULL AND ts_ms > p ORDER BY g DESC, p LIMIT 2),
gap AS (SELECT 'Gap' AS kind, from_ms, to_ms, NULL::BIGINT AS count, NULL::DOUBLE AS factor, NULL::DOUBLE AS share, NULL::VARCHAR AS snippet, g::DOUBLE AS magnitude
  FROM g3, span WHERE g >= greatest(10000, trunc((hi - lo) / n::DOUBLE * 50), trunc((hi - lo) * 0.005::DOUBLE))),
half AS (SELECT CAST(sum(n) FILTER (WHERE bin < 360) AS BIGINT) AS v1, CAST(sum(n) FILTER (WHERE bin >= 360) AS BIGINT) AS v2,
  CAST(sum(errors) FILTER (WHERE bin < 360) AS BIGINT) AS e1, CAST(sum(errors) FILTER (WHERE bin >= 360) AS BIGINT) AS e2 FROM bins),
vol AS (SELECT 'RisingVolume' AS kind, NULL::BIGINT AS from_ms, NULL::BIGINT AS to_ms, v2 AS count, v2 / v1::DOUBLE AS factor, NULL::DOUBLE AS share, NULL::VARCHAR AS snippet,
  v2 / v1::DOUBLE AS magnitude FROM half, span WHERE span.n >= 500 AND v1 > 0 AND v2 >= 2 * v1),
rer AS (SELECT 'RisingErrors' AS kind, NULL::BIGINT AS from_ms, NULL::BIGINT AS to_ms, e2 AS count, e2 / greatest(1, e1)::DOUBLE AS factor, NULL::DOUBLE AS share, NULL::VARCHAR AS snippet,
  e2 / greatest(1, e1)::DOUBLE AS magnitude FROM half, span WHERE span.n >= 500 AND e1 + e2 >= 30 AND e2 >= 3 * greatest(1, e1))"""
OBSERVED = then(BINNED, _MEDIAN, _BURST_RUNS, _SPIKES, _SPIKE_RUNS, _INSIGHTS)

_ROUNDED = "kind, from_ms, to_ms, count, round(factor, 6) AS factor, round(share, 9) AS share, snippet, round(magnitude, 6) AS magnitude"


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({"factor": F.round("factor", 6), "share": F.round("share", 9), "magnitude": F.round("magnitude", 6)})


@query("I1_robust_stats", sql("SELECT median, mad FROM rob", OBSERVED))
def robust(spark: S, sf_dir: str) -> DataFrame:
    return insights.robust_stats(stats.bins720(events(spark, sf_dir)))


@query("I2_islands", sql("""SELECT min(bin) AS first, max(bin) AS last, CAST(sum(n) AS BIGINT) AS sum FROM
  (SELECT bin, n, bin - row_number() OVER (ORDER BY bin) AS g FROM bins WHERE n > 20) GROUP BY g""", BINNED))
def islands(spark: S, sf_dir: str) -> DataFrame:
    return insights.islands(stats.bins720(events(spark, sf_dir)), "n", F.lit(20)).select("first", "last", "sum")


def _register(name: str, table: str, find) -> None:
    query(name, sql(f"SELECT {_ROUNDED} FROM {table}", OBSERVED))(lambda spark, sf_dir: _rounded(find(events(spark, sf_dir))))


_register("I3_bursts", "burst", insights.bursts)
_register("I4_error_spikes", "spike", insights.error_spikes)
_register("I5_spam", "spam", insights.spam)


@query("I5_spam_anchors", sql("SELECT from_ms, snippet, level, example, first_file, first_entry FROM spam JOIN tpl ON records = count AND first_ms = from_ms AND last_ms = to_ms AND contains(template, snippet)", then(OBSERVED, _TEMPLATES)))
def spam_anchors(spark: S, sf_dir: str) -> DataFrame:
    return insights.spam_anchors(events(spark, sf_dir))


_register("I6_gaps", "gap", insights.gaps)
_register("I7_rising_volume", "vol", insights.rising_volume)
_register("I8_rising_errors", "rer", insights.rising_errors)


@query("I9_insights", sql(f"""SELECT {_ROUNDED}, CAST(row_number() OVER (ORDER BY k, magnitude DESC, from_ms) AS INTEGER) AS rank FROM (
  SELECT 1 AS k, * FROM spike UNION ALL SELECT 2, * FROM burst UNION ALL SELECT 3, * FROM spam UNION ALL SELECT 4, * FROM gap
  UNION ALL SELECT 5, * FROM rer UNION ALL SELECT 6, * FROM vol) QUALIFY rank <= 8""", OBSERVED))
def all_insights(spark: S, sf_dir: str) -> DataFrame:
    return _rounded(insights.insights(events(spark, sf_dir)))


# ---- directories -------------------------------------------------------------------------------

_SCAN = """
files AS (SELECT file_path, count(*) AS lines, arg_min(own_ms, seq) FILTER (WHERE own_ms IS NOT NULL) AS first_ms,
  arg_max(own_ms, seq) FILTER (WHERE own_ms IS NOT NULL) AS last_ms, count(*) FILTER (WHERE own_level = 4) AS warn,
  count(*) FILTER (WHERE own_level = 5) AS error, count(*) FILTER (WHERE own_level = 6) AS fatal FROM both_cls GROUP BY file_path)"""
_BOTH = """
both_cls AS (SELECT file_path, seq, text, own_ms, own_level FROM cls UNION ALL
  SELECT '/texts/' || source || '.txt', doc_id * 1048576 + generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))), NULL, 0 FROM documents)"""
SCANNED = then(EVENT_LINES, _BOTH, _SCAN)


def _directory(spark: S, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event logs and texts as one directory: its classified lines and its files."""
    lines = views.event_lines(spark, sf_dir, BLOCK).unionByName(views.document_lines(spark, sf_dir))
    classified = classify(lines)
    return classified, directory.scan_directory(classified)


@query("A13_scan_directory", sql("SELECT * FROM files", SCANNED))
def scan(spark: S, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir)[1]


@query("A14_date_bounds", sql("SELECT min(first_ms) AS from_ms, max(last_ms) AS to_ms FROM files", SCANNED))
def bounds(spark: S, sf_dir: str) -> DataFrame:
    return directory.date_bounds(_directory(spark, sf_dir)[1])


@query("A15_match_summary", sql("""SELECT count(DISTINCT file_path) FILTER (WHERE contains(lower(text), 'event 17 ')) AS matched,
  count(DISTINCT file_path) AS files FROM both_cls""", SCANNED))
def summary(spark: S, sf_dir: str) -> DataFrame:
    lines, files = _directory(spark, sf_dir)
    return directory.content_match_summary(files, directory.filter_files_by_content(files, lines, "event 17 "))


@query("O10_sort_files", sql("SELECT file_path, fatal * 1000000000000 + error * 1000000 + warn AS alert_key FROM files ORDER BY 2 DESC, 1", SCANNED))
def sorted_files(spark: S, sf_dir: str) -> DataFrame:
    return directory.sort_files(_directory(spark, sf_dir)[1]).select("file_path", directory.alert_key().alias("alert_key"))


@query("O11_top_k", sql(f"SELECT {NORMALIZE.format('text')} AS template, count(*) AS records FROM heads GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"))
def top_k(spark: S, sf_dir: str) -> DataFrame:
    return stats.top_k(stats.template_counts(events(spark, sf_dir)), 3).select("template", "records")


@query("D1_content", sql("""SELECT file_path, lines FROM files WHERE file_path IN (
  SELECT file_path FROM both_cls WHERE regexp_matches(text, 'event 1\\d{0,1} failed'))""", SCANNED))
def by_content(spark: S, sf_dir: str) -> DataFrame:
    lines, files = _directory(spark, sf_dir)
    return directory.filter_files_by_content(files, lines, r"event 1\d{0,1} failed", regex=True, case_sensitive=True).select("file_path", "lines")


_WINDOW = (1_704_067_300_000, 1_704_067_400_000)


@query("D2_dates", sql(f"""SELECT file_path FROM files WHERE (first_ms IS NULL AND last_ms IS NULL)
  OR (last_ms >= {_WINDOW[0]} AND first_ms <= {_WINDOW[1]})""", SCANNED))
def by_date(spark: S, sf_dir: str) -> DataFrame:
    return directory.filter_files_by_date(_directory(spark, sf_dir)[1], *_WINDOW).select("file_path")


@query("D3_tree", sql(f"""SELECT path, bool_or(v) AS visible, count(*) FILTER (WHERE v) AS visible_files, count(*) AS files, bool_or(path = file_path) AS is_file FROM (
  SELECT file_path, file_path AS path, v FROM vis UNION ALL SELECT file_path, regexp_replace(file_path, '/[^/]+$', ''), v FROM vis) GROUP BY path""",
  then(SCANNED, f"""vis AS (SELECT file_path, (last_ms >= {_WINDOW[0]} AND first_ms <= {_WINDOW[1]}) IS TRUE AND warn > 0 AS v FROM files)""")))
def tree(spark: S, sf_dir: str) -> DataFrame:
    shown = directory.date_overlap(*_WINDOW) & (F.col("warn") > 0)
    return directory.directory_tree(_directory(spark, sf_dir)[1], shown)
