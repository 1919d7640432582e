"""Quality rules: a table of thresholds compiled into one projection over a text's measures.

Every measure is an expression over the words and lines of the text, so that one pass over the
documents without user functions or shuffles gives all of them.  Repeated words are found inside
the text's own array of window hashes: windows are sorted by hash, neighbours of equal hash are
compared word by word, and the covered words are counted from the places that remain.

Nulls: a null text has no words and is not kept.  Empty and blank texts likewise.  Other columns are
not read, so that clashing names do no harm; repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this from or an at have not "
    "der die das und von zu den mit ist im des auf ein eine dem sich nicht "
    "le la les de et des du en un une que pour dans est pas sur "
    "el los y se por con no su para una las del al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least <= measure <= most``; null measures (no words, no lines) fail."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


THRESHOLDS = (
    Rule("length", "n_words", 20, 1_000_000),
    Rule("word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "n_stop_words", least=1),
    Rule("bullets", "bullet_line_share", most=0.9),
    Rule("ellipses", "ellipsis_line_share", most=0.3),
    Rule("repeated_lines", "dup_line_share", most=0.5),
)


def _pieces(df: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(
        F.col(f"`{id_col}`").alias("__id"),
        body.alias("__text"),
        F.array_remove(F.split(body, f"{SPACE}+"), "").alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )


def _window(words: Column, at: Column) -> Column:
    return F.slice(words, at + 1, F.lit(WINDOW))


def _paired(df: DataFrame, source: str, target: str, apart: int) -> DataFrame:
    """Hashes of two entries ``apart``; three times this, from words on, hashes windows of eight words."""
    n = F.size(source)
    at = F.when(n > apart, F.sequence(F.lit(0), n - 1 - apart)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(target, F.transform(at, lambda i: F.xxhash64(F.get(F.col(source), i), F.get(F.col(source), i + apart))))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``__places``: the sorted places of windows that occur more than once."""
    words = F.col("__words")
    hashed = _paired(_paired(_paired(df, "__words", "__h2", 1), "__h2", "__h4", 2), "__h4", "__h8", 4)
    # Only a text with equal hashes sorts its windows; neighbours of equal hash are then compared word by word.
    pairs = F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    sorted_ = hashed.withColumn(
        "__sorted", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    )

    def equal(w: Column, i: Column) -> Column:
        other = F.get(F.col("__sorted"), i)
        return F.coalesce((other["h"] == w["h"]) & (_window(words, other["p"]) == _window(words, w["p"])), F.lit(False))

    found = F.filter("__sorted", lambda w, i: equal(w, i - 1) | equal(w, i + 1))
    return sorted_.withColumn("__places", F.array_sort(F.transform(found, lambda w: w["p"])))


def measures(df: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text with all measures."""
    words, lines, body = F.col("__words"), F.col("__lines"), F.col("__text")
    # Each place covers words up to the next place, eight at most.
    covered = F.aggregate(
        "__places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    n_words, n_lines = F.size(words), F.size(lines)
    chars = F.length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))
    symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]"))
    dup_lines = n_lines - F.size(F.array_distinct(lines))
    share = lambda part, whole: F.when(whole > 0, part / whole)
    return _with_repeats(_pieces(df, id_col, text)).select(
        F.col("__id").alias(id_col),
        n_words.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        share(chars, n_words).alias("mean_word_chars"), share(symbols, n_words).alias("symbols_per_word"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        share(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))), n_lines).alias("bullet_line_share"),
        share(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), n_lines).alias("ellipsis_line_share"),
        share(dup_lines, n_lines).alias("dup_line_share"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures fails, as one array expression."""
    failed = []
    for rule in rules:
        value = F.col(rule.measure)
        passes = F.lit(True)
        if rule.least is not None:
            passes = passes & (value >= rule.least)
        if rule.most is not None:
            passes = passes & (value <= rule.most)
        failed.append(F.when(~F.coalesce(passes, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def quality(df: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, the rules that failed, and whether the text is kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measures(df, id_col=id_col, text=text).withColumns({"base_failed": base, "failed": compiled(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
