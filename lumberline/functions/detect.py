"""Timestamp and level detection on a line of text, as Column expressions.

Times are wall-clock times without a zone.  They are carried as ``BIGINT`` milliseconds since
1970-01-01 00:00 (``*_ms``): integer arithmetic is the same in every session time zone, stays in
generated code, and gives Parquet tight min/max statistics.  ``ms_to_ntz`` turns them into
``TIMESTAMP_NTZ`` for display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level numbers and names.
LEVELS = ("UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
UNKNOWN, TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(7)

ISO_PATTERN = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
# A keyword counts only as a whole ASCII word; Java's own \b also looks at other letters.  The first
# test keeps the costlier ones from all places where no keyword can start.
LEVEL_PATTERN = (
    r"(?=[DEFITWdefitw])(?<![A-Za-z0-9_])((?i:TRACE|DEBUG|INFO|WARNING|WARN|ERROR|FATAL))(?![A-Za-z0-9_])"
)

DAY_MS = 86_400_000


def level_from_name(name: Column) -> Column:
    """Level number of a level name; blanks around it and case do not matter."""
    known = F.array(*[F.lit(n) for n in (*LEVELS, "WARNING")])
    numbers = F.array(*[F.lit(n) for n in (UNKNOWN, *range(7), WARN)])
    return F.get(numbers, F.coalesce(F.array_position(known, F.upper(F.trim(name))), F.lit(0)).cast("int"))


def level_name(level: Column) -> Column:
    """Name of a level number."""
    return F.get(F.array(*[F.lit(n) for n in LEVELS]), level)


def detect_level(text: Column) -> Column:
    """Number of the leftmost level keyword in the text, 0 if there is none."""
    return level_from_name(F.regexp_extract(text, LEVEL_PATTERN, 1))


def _int(text: Column, pos: int, length: int) -> Column:
    return F.substring(text, pos, length).try_cast("int")


def _stands(text: Column, sep: str) -> Column:
    """Whether a text starts like ``dd?MM?yyyy HH:mm:ss`` with the given separator."""
    frame = {3: sep, 6: sep, 11: " ", 14: ":", 17: ":"}
    conditions = [F.substring(text, at, 1) == mark for at, mark in frame.items()]
    whole = F.length(text) >= 19
    for condition in conditions:
        whole = condition & whole
    return whole


def _date_text(text: Column, day_at: int, month_at: int) -> Column:
    """``yyyy-MM-dd`` from a text with the year at 7; blanks stand for leading zeros."""
    parts = ((7, 4), (month_at, 2), (day_at, 2))
    return F.concat_ws("-", *[F.lpad(F.trim(F.substring(text, at, n)), n, "0") for at, n in parts])


def _day(date_text: Column) -> Column:
    """Days since 1970.  The cast refuses days that do not exist; year 0 exists for Spark but not here.

    The cast would also take ``2026-07-1T`` for a date, so that all but digits must be the dashes.
    """
    only_digits = F.translate(date_text, "0123456789", "") == "--"
    return F.when(only_digits & ~date_text.startswith("0000"), F.unix_date(date_text.try_cast("date")))


def _clock_ms(clock: Column) -> Column:
    hour, minute, second = _int(clock, 1, 2), _int(clock, 4, 2), _int(clock, 7, 2)
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(ok, (hour * 3600 + minute * 60 + second) * 1000)


def with_timestamp(rows: DataFrame, text: str = "text", out: str = "own_ms") -> DataFrame:
    """Add the timestamp of a text in milliseconds, or null.

    The leftmost ISO form decides, wherever it stands: if it names no real moment the text has no
    timestamp.  Only texts without any ISO form are tried for a date at their start: dd/MM/yyyy,
    else MM/dd/yyyy; or dd.MM.yyyy.

    Each step is a column of its own.  Spark keeps a column that is used several times, so that
    the pattern runs once per line and the generated code stays small.
    """
    line, token = F.col(text), F.col("_token")
    has_token = token != ""
    slashed, dotted = _stands(line, "/"), _stands(line, ".")
    fraction = F.when(F.length(token) > 19, F.substring(token, 21, 1 << 20).try_cast("int")).otherwise(0)
    found = rows.withColumn("_token", F.regexp_extract(line, ISO_PATTERN, 0))
    found = found.withColumns(
        {
            "_form": F.when(has_token, 1).when(slashed, 2).when(dotted, 3),
            "_millis": F.when(has_token, fraction).otherwise(0),
        }
    )
    form = F.col("_form")
    found = found.withColumns(
        {
            "_date": F.when(form == 1, F.substring(token, 1, 10)).when(form >= 2, _date_text(line, 1, 4)),
            "_swapped": F.when(form == 2, _date_text(line, 4, 1)),
            "_clock": F.when(form == 1, F.substring(token, 12, 8)).when(form >= 2, F.substring(line, 12, 8)),
        }
    )
    found = found.withColumns(
        {"_days": F.coalesce(_day(F.col("_date")), _day(F.col("_swapped"))), "_in_day": _clock_ms(F.col("_clock"))}
    )
    millis = F.when(F.col("_millis").between(0, 999), F.col("_millis"))
    total = F.col("_days").cast("bigint") * DAY_MS + F.col("_in_day") + millis
    return found.withColumn(out, total).drop("_token", "_form", "_millis", "_date", "_swapped", "_clock", "_days", "_in_day")


def ms_to_ntz(ms: Column) -> Column:
    """Milliseconds since 1970 as ``TIMESTAMP_NTZ``, independent of the session time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '0.001' SECOND") * ms


def ntz_to_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a wall-clock timestamp (microseconds are cut)."""
    second = F.extract(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY_MS
        + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1000
        + F.floor(second * 1000).cast("bigint")
    )


def ms_text(ms: Column, fraction: str = ",") -> Column:
    """``yyyy-MM-dd HH:mm:ss,zzz`` of a millisecond time."""
    out = F.substring(ms_to_ntz(ms).cast("string"), 1, 19)
    if fraction:
        millis = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
        out = F.concat(out, F.lit(fraction), millis)
    return out


def classify(lines: DataFrame, schema_matched: Column | None = None) -> DataFrame:
    """Add ``own_ms``, ``own_level`` and ``is_primary`` to a table with a ``text`` column.

    A line starts a record if the extraction schema recognised it, or if it has both a
    timestamp and a level.
    """
    out = with_timestamp(lines).withColumn("own_level", detect_level(F.col("text")))
    both = F.col("own_ms").isNotNull() & (F.col("own_level") > 0)
    primary = both if schema_matched is None else both | F.coalesce(schema_matched, F.lit(False))
    return out.withColumn("is_primary", primary)
