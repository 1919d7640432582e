"""Text functions for report columns: templates, durations, ranges, badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column, chars: int | None = None) -> Column:
    """Template of a whole message: every word with a digit in it becomes ``#``.

    ``chars`` shortens the message first, for a display; what is counted is never shortened.
    """
    # Tried at the start of a word only, and without going back: each character is looked at once.
    pattern = r"(?<![\p{L}\p{N}_])[[\p{L}\p{N}_]&&[^\p{Nd}]]*+\p{Nd}[\p{L}\p{N}_]*+"
    if chars is None:
        return F.regexp_replace(text, pattern, "#")
    head = F.regexp_replace(F.left(text, F.lit(chars)), pattern, "#")
    return F.when(F.length(text) > chars, F.concat(head, F.lit(" …"))).otherwise(head)


def template_display(template: Column) -> Column:
    """The template from its first two letters in a row on, the template itself if there are none."""
    return F.regexp_replace(template, r"^(?s).*?(?=\p{L}\p{L})", "")


def duration_text(ms: Column) -> Column:
    """``350 ms``, ``12 s``, ``4 min 30 s``, ``1 h 05 min``, ``6 d 06 h``."""
    units = [(1000, "ms"), (60, "s"), (60, "min"), (24, "h")]
    whole, parts, rest = ms.cast("bigint"), [], None
    for size, name in units:
        parts.append((whole, rest, name, size))
        rest, whole = F.pmod(whole, F.lit(size)), F.floor(whole / size)

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    def plain(value: Column, name: str) -> Column:
        return F.concat(value.cast("string"), F.lit(f" {name}"))

    (msec, _, _, _), (sec, _, _, _), (minute, s_rest, _, _), (hour, m_rest, _, _) = parts
    return (
        F.when(msec < 1000, plain(msec, "ms"))
        .when(sec < 60, plain(sec, "s"))
        .when(minute < 60, F.concat(plain(minute, "min "), two(s_rest), F.lit(" s")))
        .when(hour < 24, F.concat(plain(hour, "h "), two(m_rest), F.lit(" min")))
        .otherwise(F.concat(plain(whole, "d "), two(rest), F.lit(" h")))
    )


def range_text(from_ms: Column, to_ms: Column) -> Column:
    """``12:01:10 – 12:02:20``; the end carries its date only if the day changes."""
    from lumberline.functions.detect import ms_text

    start, end = ms_text(from_ms, ""), ms_text(to_ms, "")
    dated = F.concat(
        F.substring(end, 9, 2), F.lit("."), F.substring(end, 6, 2), F.lit(" "), F.substring(end, 12, 8)
    )
    same_day = F.substring(start, 1, 10) == F.substring(end, 1, 10)
    return F.concat(
        F.substring(start, 12, 8), F.lit(" – "), F.when(same_day, F.substring(end, 12, 8)).otherwise(dated)
    )


def alert_text(warn: Column, error: Column, fatal: Column) -> Column:
    """``W/E/F`` with blanks for zeros; a dash if all are zero."""

    def part(n: Column) -> Column:
        return F.when(n > 0, n.cast("string")).otherwise(F.lit(""))

    none = (warn == 0) & (error == 0) & (fatal == 0)
    return F.when(none, F.lit("—")).otherwise(F.concat_ws("/", part(warn), part(error), part(fatal)))


def ellipsis(text: Column, chars: int) -> Column:
    """The text, cut to ``chars`` characters with a trailing ``…`` if it is longer."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("…"))).otherwise(text)
