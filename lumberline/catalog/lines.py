"""Registered queries: sources, classification, records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import (
    BLOCK, BRACKET_ROWS, DOCUMENT_LINES, EVENT_LINES, EVENT_ROWS, EVENT_SCHEMA, documents, event_fields, events, query,
    original_path, scratch, sql, stored, then, write_files,
)
from lumberline.functions import detect
from lumberline.operators import documents as docs
from lumberline.operators import extract, records
from lumberline.plans.importers import PRESETS
from lumberline.session import staged
from lumberline.sources import files, manifest, sinks, views
from lumberline.sources.storage import Storage

S = SparkSession


@query("S1_read_log", sql("SELECT text, count(*) AS n FROM raw GROUP BY text", EVENT_ROWS))
def read_log(spark: S, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "log-files")
    views.event_lines(spark, sf_dir, BLOCK).select("text").write.text(folder)
    return files.read_lines(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("S2_line_ends", sql("SELECT text, count(*) AS n, CAST(0 AS BIGINT) AS unfinished FROM raw GROUP BY text", EVENT_ROWS))
def line_ends(spark: S, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "crlf-files")
    views.event_lines(spark, sf_dir, BLOCK).select("text").write.option("lineSep", "\r\n").text(folder)
    return files.read_log(spark, folder).groupBy("text").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("provisional").alias("unfinished"))


@query("S3_wide_encoding", sql("SELECT text, count(*) AS n FROM parts GROUP BY text", DOCUMENT_LINES))
def wide_encoding(spark: S, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "utf16-files")
    text = F.encode(F.col("text"), "UTF-16LE")
    # Raw bytes go through the text writer unchanged; its line ends are those of the encoding.
    writer = views.document_lines(spark, sf_dir).select(text.cast("string").alias("text")).write
    writer.option("lineSep", "\n\0").text(folder)
    return files.read_lines(spark, folder, "UTF-16LE").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_ENCODED = {"UTF-8": "utf-8", "UTF-8 with mark": "utf-8-sig", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le", "UTF-32BE": "utf-32-be"}


@query("S3_mixed_encodings", sql("SELECT file_path, line_no, text, line_no = max(line_no) OVER (PARTITION BY file_path) AS provisional FROM lines", DOCUMENT_LINES))
def mixed_encodings(spark: S, sf_dir: str) -> DataFrame:
    """The texts as files in an encoding each, with byte order marks where the encoding needs one; the last lines are open."""
    folder, names = scratch(spark, "encoded-files"), list(_ENCODED.values())
    lines = views.document_lines(spark, sf_dir).select("file_path", "seq", "text")
    # One row per file; as a table its size is known, so that the lines are not moved for it.
    ends = staged(lines.groupBy("file_path").agg(F.min("seq").alias("first"), F.max("seq").alias("last")), "file-ends")
    number = F.pmod(F.crc32(F.col("file_path").cast("binary")), F.lit(len(names))).cast("int")
    text = F.concat(F.when((F.col("seq") == F.col("first")) & (number > 0), "\ufeff").otherwise(""), "text", F.when(F.col("seq") < F.col("last"), "\n").otherwise(""))

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series, which: pd.Series) -> pd.Series:
        # The mark is in the text, so that every line is encoded alike.
        return pd.Series([t.encode(names[i].removesuffix("-sig")) for t, i in zip(texts, which, strict=True)])

    placed = lines.join(ends, "file_path").select("file_path", "seq", text.alias("text"))
    write_files(placed, folder, encoded(F.col("text"), number))
    log = files.read_log(spark, folder, "auto")
    return log.select(original_path("/texts").alias("file_path"), "line_no", "text", "provisional")


@query("S4_discover", sql("SELECT DISTINCT f AS log FROM st", EVENT_ROWS))
def discover(spark: S, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "found-files")
    views.event_lines(spark, sf_dir, BLOCK).withColumn("log", F.col("file_path")).select("log", "text").write.partitionBy("log").text(folder)
    found = files.discover_logs(spark, folder, ("TXT",))
    return found.select(F.url_decode(F.regexp_extract("file_path", "/log=([^/]+)/", 1)).alias("log")).distinct()


@query("S5_merge", sql("""SELECT file_path, count(*) AS n FROM
  (SELECT file_path FROM lines UNION ALL SELECT '/texts/' || source || '.txt' FROM documents, unnest(string_split(text, chr(10)))) GROUP BY file_path"""))
def merge(spark: S, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    merged = docs.merge_logs(log, documents(spark, sf_dir), log)
    return merged.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("S6_drop_file", sql("SELECT file_path, line_no, level FROM lines WHERE file_path <> '/logs/app1.log'"))
def drop_file(spark: S, sf_dir: str) -> DataFrame:
    return docs.drop_file(events(spark, sf_dir), "/logs/app1.log").select("file_path", "line_no", "level")


_CUT = 1_707_000_000_000
_STATES = f"""
old AS (SELECT file_path, CAST(sum(strlen(text) + 1) AS BIGINT) AS consumed, md5(arg_max(text, line_no)) AS fingerprint
  FROM lines WHERE ts_ms < {_CUT} AND file_path <> '/logs/app3.log' GROUP BY file_path),
cur AS (SELECT file_path, CAST(sum(strlen(text) + 1) AS BIGINT) AS size,
  CASE WHEN file_path = '/logs/app1.log' THEN 'rewritten' ELSE md5(arg_max(text, CASE WHEN ts_ms < {_CUT} THEN line_no END)) END AS now
  FROM lines WHERE file_path <> '/logs/app2.log' GROUP BY file_path),
diff AS (SELECT coalesce(old.file_path, cur.file_path) AS file_path, consumed, size,
  CASE WHEN consumed IS NULL THEN 'new' WHEN size IS NULL THEN 'missing' WHEN size < consumed THEN 'replaced'
    WHEN fingerprint IS DISTINCT FROM now THEN 'replaced' WHEN size > consumed THEN 'appended' ELSE 'unchanged' END AS change
  FROM old FULL OUTER JOIN cur USING (file_path))"""


def _changes(log: DataFrame) -> DataFrame:
    """Two states of the event logs: one file grew, one was rewritten, one is missing, one is new."""
    size = F.sum(F.octet_length("text") + 1).cast("bigint")
    early = F.when(F.col("ts_ms") < _CUT, F.col("line_no"))
    old = log.where(F.col("ts_ms") < _CUT).where("file_path <> '/logs/app3.log'").groupBy("file_path").agg(
        size.alias("consumed"), F.md5(F.max_by("text", "line_no")).alias("fingerprint"))
    new = log.where("file_path <> '/logs/app2.log'").groupBy("file_path").agg(
        size.alias("size"), F.md5(F.max_by("text", early)).alias("kept"))
    rewritten = F.when(F.col("file_path") == "/logs/app1.log", "rewritten").otherwise(F.col("kept"))
    return manifest.diff_manifest(old, new.select("file_path", "size", rewritten.alias("fingerprint")))


@query("S7_diff_manifest", sql("SELECT file_path, consumed, size, change FROM diff", then(EVENT_LINES, _STATES)))
def diff_manifest(spark: S, sf_dir: str) -> DataFrame:
    return _changes(events(spark, sf_dir))


@query("S8_refresh", sql(f"""SELECT file_path, count(*) AS lines, max(ts_ms) AS last_ms FROM (
  SELECT file_path, ts_ms FROM lines WHERE ts_ms < {_CUT} AND file_path IN ('/logs/app0.log')
  UNION ALL SELECT file_path, ts_ms FROM lines WHERE ts_ms >= {_CUT} AND file_path = '/logs/app0.log'
  UNION ALL SELECT file_path, ts_ms FROM lines WHERE file_path IN ('/logs/app1.log', '/logs/app3.log')) GROUP BY file_path"""))
def refresh(spark: S, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("provisional", F.lit(False))
    before = log.where(F.col("ts_ms") < _CUT).where("file_path <> '/logs/app3.log'")
    changes = _changes(log)
    kind = log.join(changes.select("file_path", "change"), "file_path")
    tail = (F.col("change") == "appended") & (F.col("ts_ms") >= _CUT)
    fresh = kind.where(F.col("change").isin("new", "replaced") | tail).drop("change")
    return manifest.refresh(before, changes, fresh).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.max("ts_ms").alias("last_ms"))


def _old_files(log: DataFrame) -> DataFrame:
    """The event logs as they were: one half as long and cut within a line, one yet to come."""
    ends = log.groupBy("file_path").agg(F.max("line_no").alias("last"))
    half = F.when(F.col("file_path") == "/logs/app0.log", F.floor(F.col("last") / 2)).otherwise(F.col("last"))
    kept = log.where("file_path <> '/logs/app3.log'").join(ends.withColumn("last", half), "file_path").where("line_no <= last")
    cut = (F.col("line_no") == F.col("last")) & (F.col("file_path") == "/logs/app0.log")
    data = F.when(cut, F.left(F.col("text"), F.lit(9))).otherwise(F.concat("text", F.lit("\n")))
    return kept.select("file_path", F.col("line_no").alias("seq"), data.alias("data"))


def _new_files(log: DataFrame) -> DataFrame:
    """The event logs as they are: one grew, one was rewritten, one is new."""
    text = F.when(F.col("file_path") == "/logs/app1.log", F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    return log.where("file_path <> '/logs/app2.log'").select("file_path", F.col("line_no").alias("seq"), F.concat(text, F.lit("\n")).alias("data"))


def _changed_files(spark: S, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Real files, read once and then changed: what was read, the old manifest, and what changed."""
    log = events(spark, sf_dir).select("file_path", "line_no", "text")
    folder = scratch(spark, "changing-files")
    write_files(_old_files(log), folder)
    before = manifest.capture_manifest(files.discover_logs(spark, folder))
    lines = staged(files.read_log(spark, folder), "known-lines")
    write_files(_new_files(log), folder)
    system, inside = Storage.of(spark).resolve(f"{folder}/app2.log")
    system.delete_file(inside)
    now = manifest.current_state(files.discover_logs(spark, folder), before)
    return lines, before, staged(manifest.diff_manifest(before, now), "changes-of-files")


_FILE_STATES = """
parts AS (SELECT file_path, line_no, strlen(text) + 1 AS bytes, max(line_no) OVER (PARTITION BY file_path) AS last FROM lines),
sizes AS (SELECT file_path, CAST(sum(CASE WHEN file_path <> '/logs/app0.log' OR line_no < last // 2 THEN bytes ELSE 0 END) AS BIGINT) AS consumed,
  CAST(sum(bytes + CASE WHEN file_path = '/logs/app1.log' THEN 6 ELSE 0 END) AS BIGINT) AS size FROM parts GROUP BY file_path)"""


@query("S7_changed_files", sql("""SELECT file_path, CASE WHEN file_path <> '/logs/app3.log' THEN consumed END AS consumed, CASE WHEN file_path <> '/logs/app2.log' THEN size END AS size,
  CASE file_path WHEN '/logs/app0.log' THEN 'appended' WHEN '/logs/app1.log' THEN 'replaced' WHEN '/logs/app2.log' THEN 'missing' ELSE 'new' END AS change FROM sizes""", then(EVENT_LINES, _FILE_STATES)))
def changed_files(spark: S, sf_dir: str) -> DataFrame:
    _, _, changes = _changed_files(spark, sf_dir)
    return changes.select(original_path("/logs").alias("file_path"), "consumed", "size", "change")


@query("S8_refreshed_files", sql("""SELECT file_path, line_no, logical_id, ts_ms, level, CASE WHEN file_path = '/logs/app1.log' THEN text || ' again' ELSE text END AS text
  FROM lines WHERE file_path <> '/logs/app2.log'"""))
def refreshed_files(spark: S, sf_dir: str) -> DataFrame:
    lines, _, changes = _changed_files(spark, sf_dir)
    found = manifest.refresh(lines, changes, manifest.read_changes(lines, changes))
    return found.select(original_path("/logs").alias("file_path"), "line_no", "logical_id", "ts_ms", "level", "text")


@query("S9_save_view", sql("SELECT text, count(*) AS n FROM lines WHERE level >= 5 GROUP BY text"))
def save_view(spark: S, sf_dir: str) -> DataFrame:
    target = scratch(spark, "saved-view")
    sinks.save_view(events(spark, sf_dir).where("level >= 5"), target)
    return files.read_lines(spark, target).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_VARIANTS = r"""
t AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%d') AS d, strftime(ts, '%m') AS m,
  strftime(ts, '%Y') AS y, strftime(ts, '%H:%M:%S') AS c, epoch_ms(date_trunc('second', ts)) AS ms, event_id % 10 AS k FROM events),
swapped AS (SELECT *, CASE WHEN CAST(d AS INTEGER) <= 12 THEN epoch_ms(TRY_CAST(y || '-' || d || '-' || m || ' ' || c AS TIMESTAMP)) ELSE ms END AS sw FROM t)"""


@query("L1_timestamps", sql("""SELECT event_id, CASE k WHEN 0 THEN ms WHEN 1 THEN ms + 7 WHEN 3 THEN ms WHEN 4 THEN sw
  WHEN 5 THEN ms WHEN 9 THEN ms END AS ts_ms FROM swapped""", _VARIANTS))
def timestamps(spark: S, sf_dir: str) -> DataFrame:
    return detect.with_timestamp(views.stamp_variants(spark, sf_dir), out="ts_ms").select("event_id", "ts_ms")


@query("L2_levels", sql("SELECT event_id, CASE k WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 5 THEN 2 WHEN 8 THEN 6 ELSE 0 END AS level FROM t", _VARIANTS))
def levels(spark: S, sf_dir: str) -> DataFrame:
    return views.stamp_variants(spark, sf_dir).select("event_id", detect.detect_level(F.col("text")).alias("level"))


@query("L3_level_names", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 6 WHEN o_orderstatus = 'P' THEN 4 ELSE 0 END AS level, "
       "CASE WHEN o_orderstatus = 'F' THEN 'FATAL' WHEN o_orderstatus = 'P' THEN 'WARN' ELSE 'UNKNOWN' END AS level_name FROM orders")
def level_names(spark: S, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    name = F.when(status == "F", " fatal ").when(status == "P", "Warning").otherwise("none")
    level = detect.level_from_name(name)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), detect.level_name(level).alias("level_name"))


@query("L4_primary", sql("SELECT file_path, seq, own_ms, own_level, own_ms IS NOT NULL AND own_level > 0 AS is_primary FROM cls"))
def primary(spark: S, sf_dir: str) -> DataFrame:
    return detect.classify(views.event_lines(spark, sf_dir, BLOCK)).select("file_path", "seq", "own_ms", "own_level", "is_primary")


@query("L4_primary_by_schema", sql("""SELECT file_path, row_number() OVER w AS line_no, row_number() OVER w - 1 AS logical_id, ms AS ts_ms,
  CASE WHEN broken THEN 0 WHEN lv = 'ERROR' THEN 5 WHEN lv = 'WARN' THEN 4 ELSE 3 END AS level, false AS is_plain
  FROM brk WINDOW w AS (PARTITION BY file_path ORDER BY seq)""", BRACKET_ROWS))
def primary_by_schema(spark: S, sf_dir: str) -> DataFrame:
    log = extract.structured_log(views.bracket_lines(spark, sf_dir), PRESETS["bracketed"])
    return log.select("file_path", "line_no", "logical_id", "ts_ms", "level", "is_plain")


@query("S1_ingest", sql("SELECT text, level, count(*) AS n FROM (SELECT text, own_level AS level FROM cls) GROUP BY text, level"))
def ingest(spark: S, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "log-files")
    views.event_lines(spark, sf_dir, BLOCK).select("text").write.text(folder)
    table = files.ingest_log(spark, folder, scratch(spark, "log-table"), schema=EVENT_SCHEMA)
    return table.groupBy("text", F.col("own_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("L5_line_numbers", sql("SELECT file_path, seq, line_no FROM lines"))
def line_numbers(spark: S, sf_dir: str) -> DataFrame:
    return records.number_lines(views.event_lines(spark, sf_dir, BLOCK)).select("file_path", "seq", "line_no")


@query("L6_record_ids", sql("SELECT file_path, line_no, logical_id FROM lines"))
def record_ids(spark: S, sf_dir: str) -> DataFrame:
    return views.event_log(spark, sf_dir, BLOCK).select("file_path", "line_no", "logical_id")


@query("L7_inherit", sql("SELECT file_path, line_no, ts_ms, level FROM lines"))
def inherit(spark: S, sf_dir: str) -> DataFrame:
    return views.event_log(spark, sf_dir, BLOCK).select("file_path", "line_no", "ts_ms", "level")


@query("L8_plain", sql("SELECT file_path, line_no, is_plain FROM lines", DOCUMENT_LINES))
def plain(spark: S, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("file_path", "line_no", "is_plain")


@query("L9_records", sql(r"""SELECT file_path, logical_id, min(line_no) AS first_line, count(*) AS n_lines, ts_ms, level,
  string_agg(text, chr(10) ORDER BY line_no) AS text, false AS truncated FROM lines
  GROUP BY file_path, logical_id, CASE WHEN is_plain THEN line_no ELSE 0 END, ts_ms, level"""))
def assembled(spark: S, sf_dir: str) -> DataFrame:
    return records.assemble_records(events(spark, sf_dir), max_lines=None, max_chars=None)


_CHUNK = 1 << 18
_DUMP = f"""
dump AS (SELECT CAST(-1 AS BIGINT) AS seq, '{views.DUMP_START}all items' AS text UNION ALL
  SELECT l_orderkey * 64 + l_linenumber, l_orderkey || ' | ' || l_linenumber || ' | rows ' || count(*) || ' | qty ' || CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS VARCHAR)
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
whole AS (SELECT string_agg(text, chr(10) ORDER BY seq) AS t FROM dump),
cut AS (SELECT k AS chunk_no, substr(t, k * {_CHUNK} + 1, {_CHUNK}) AS text FROM whole, range((length(t) + {_CHUNK - 1}) // {_CHUNK}) r(k))"""


@query("L9_record_chunks", sql("""SELECT '/dumps/items.log' AS file_path, CAST(0 AS BIGINT) AS logical_id, CAST(1 AS BIGINT) AS first_line, chunk_no,
  length(text) - length(replace(text, chr(10), '')) + CASE WHEN chunk_no = 0 THEN 1 ELSE 0 END AS n_lines, 1704067200000 AS ts_ms, 3 AS level, text FROM cut""", _DUMP))
def chunked(spark: S, sf_dir: str) -> DataFrame:
    log = stored(spark, sf_dir, "dump", lambda s, d: records.assign_records(detect.classify(views.dump_lines(s, d))))
    return records.record_chunks(log, _CHUNK)


@query("L10_headers", sql("""SELECT file_path, level, ts_ms, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines,
  is_plain, CASE WHEN NOT is_plain THEN logical_id END AS entry_no FROM lines
  GROUP BY file_path, logical_id, CASE WHEN is_plain THEN line_no ELSE 0 END, level, ts_ms, is_plain"""))
def headers(spark: S, sf_dir: str) -> DataFrame:
    return records.record_headers(events(spark, sf_dir))


@query("L11_record_fields", sql("""SELECT l.file_path, l.logical_id, st.stamp AS ts_text, st.lv AS lv, st.event_type AS kind, st.msg AS message
  FROM lines l JOIN st ON l.file_path = st.f AND l.seq = st.event_id * 4"""))
def record_fields(spark: S, sf_dir: str) -> DataFrame:
    found = records.record_fields(event_fields(spark, sf_dir))
    f = F.col("fields")
    return found.select("file_path", "logical_id", f["Timestamp"].alias("ts_text"), f["Level"].alias("lv"),
                        f["Kind"].alias("kind"), f["Message"].alias("message"))


@query("L12_new_rows", sql(f"SELECT file_path, line_no, coalesce(ts_ms >= {_CUT}, false) AS is_new FROM lines"))
def new_rows(spark: S, sf_dir: str) -> DataFrame:
    batch = F.when(F.col("ts_ms") >= _CUT, 2).otherwise(1)
    return records.mark_new(events(spark, sf_dir).withColumn("ingest_batch", batch)).select("file_path", "line_no", "is_new")


@query("A2_record_heads", sql("SELECT file_path, line_no, text FROM lines WHERE level = 5 AND text LIKE '%at app%'"))
def filtered_heads(spark: S, sf_dir: str) -> DataFrame:
    # A view of stack lines only: each is then the first line left of its record.
    view = events(spark, sf_dir).where((F.col("level") == 5) & F.col("text").contains("at app"))
    return records.record_heads(view, filtered=True).select("file_path", "line_no", "text")
