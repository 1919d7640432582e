"""Row markers, match spans and match counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.markers import Markers
from lumberline.functions.rules import Rule, java_regex, literal_regex, rule_condition, usable

def _active(patterns: list[Rule]) -> list[tuple[int, Rule]]:
    return [(i, p) for i, p in enumerate(patterns) if usable(p)]


def pattern_regex(pattern: Rule) -> str:
    return java_regex(pattern.text if pattern.regex else literal_regex(pattern.text), pattern.case_sensitive)


def mark_rows(lines: DataFrame, patterns: list[Rule], out: str = "marker") -> DataFrame:
    """Add the colour of the first pattern found in the line, null if there is none."""
    marker: Column = F.lit(None).cast("string")
    for _, pattern in reversed(_active(patterns)):
        marker = F.when(rule_condition(pattern, F.col("text")), F.lit(pattern.color)).otherwise(marker)
    return lines.withColumn(out, marker)


def _sizes(text: Column, pattern: Rule) -> Column:
    """Lengths of what lies outside and inside the matches of a pattern, in turn.

    One replacement brackets every match, so that each stands where the pattern found it.
    """
    marks = Markers(pattern.text)
    marked = F.regexp_replace(marks.cleared(text, marks.pair(text)), pattern_regex(pattern), f"{marks.first}$0{marks.second}")
    return F.transform(F.split(marked, f"[{marks.first}{marks.second}]", -1), F.length)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def match_spans(lines: DataFrame, patterns: list[Rule]) -> DataFrame:
    """One row per match: file, line, number of the pattern, start (from 0) and length.

    Starts are sums of all lengths before, taken in two steps: over runs of about the root of the number of pieces,
    and within a run.  Each step is a column, so that none is computed once per match.  Empty matches are left out.
    """
    active = _active(patterns)
    if not active:
        return lines.select("file_path", "line_no", F.lit(0).alias("pattern"), F.lit(0).alias("start"),
                            F.lit(0).alias("length")).where(F.lit(False))
    text = F.col("text")
    none = F.array().cast("array<int>")
    sizes = {f"_s{i}": F.when(rule_condition(p, text), _sizes(text, p)).otherwise(none) if p.action == "include" else _sizes(text, p) for i, p in active}
    out = lines.select("file_path", "line_no", *[c.alias(name) for name, c in sizes.items()])
    numbers = [i for i, _ in active]
    out = out.withColumns({f"_w{i}": F.greatest(F.ceil(F.sqrt(F.size(f"_s{i}"))).cast("int"), F.lit(1)) for i in numbers})

    def totals(i: int) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_s{i}") - 1) / F.col(f"_w{i}")).cast("int")), lambda r: r * F.col(f"_w{i}") + 1)
        return F.when(F.size(f"_s{i}") > 1, F.transform(starts, lambda k: _total(F.slice(f"_s{i}", k, F.col(f"_w{i}"))))).otherwise(none)

    def before(i: int) -> Column:
        return F.transform(f"_t{i}", lambda _, r: _total(F.slice(f"_t{i}", 1, r)))

    out = out.withColumns({f"_t{i}": totals(i) for i in numbers})
    out = out.withColumns({f"_b{i}": before(i) for i in numbers})

    def spans(i: int) -> Column:
        run, sizes = F.col(f"_w{i}"), F.col(f"_s{i}")
        places = F.filter(F.transform(sizes, lambda n, k: F.struct(k.alias("at"), n.alias("length"))), lambda x: (x["at"] % 2 == 1) & (x["length"] > 0))

        def one(x: Column) -> Column:
            r = F.floor(x["at"] / run).cast("int")
            start = F.get(F.col(f"_b{i}"), r) + _total(F.slice(sizes, r * run + 1, x["at"] - r * run))
            return F.struct(F.lit(i).alias("pattern"), start.alias("start"), x["length"].alias("length"))

        return F.transform(places, one)

    return out.select("file_path", "line_no", F.inline(F.concat(*map(spans, numbers))))


def match_counts(lines: DataFrame, patterns: list[Rule]) -> DataFrame:
    """Lines with a match and number of matches, per pattern."""
    active = _active(patterns)
    if not active:
        return lines.sparkSession.createDataFrame([], "pattern int, text string, lines bigint, matches bigint")
    aggs = []
    for i, pattern in active:
        rx = pattern_regex(pattern)
        aggs += [
            F.count_if(F.col("text").rlike(rx)).alias(f"lines{i}"),
            F.coalesce(F.sum(F.regexp_count("text", F.lit(rx))), F.lit(0)).cast("bigint").alias(f"matches{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("pattern"), F.lit(p.text).alias("text"),
                 F.col(f"lines{i}").alias("lines"), F.col(f"matches{i}").alias("matches"))
        for i, p in active
    ])
    return lines.agg(*aggs).select(F.inline(rows))
