"""What stands out in a document: bursts, error spikes, spam, silences, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.text import template_display
from lumberline.operators.stats import (
    BINS, bin_start, bins720, counted_records, template_counts, templates, top_k,
)
from lumberline.session import pinned

# Order in which insights are listed.
KINDS = ["ErrorSpike", "Burst", "Spam", "Gap", "RisingErrors", "RisingVolume"]
MAX_INSIGHTS = 8

# Thresholds.
BURST_MAD, MAD_TO_SIGMA, BURST_MEAN, BURST_FLOOR, BURST_RECORDS = 6.0, 1.4826, 3.0, 8.0, 50
SPIKE_SIGMA, SPIKE_FLOOR, SPIKE_ERRORS = 6.0, 5.0, 20
SPAM_RECORDS, SPAM_PART, SPAM_SHARE, SPAM_PER_SEC, SPAM_TIMES = 100, 50, 0.20, 5.0, 8.0
GAP_MS, GAP_MEANS, GAP_SPAN = 10_000, 50.0, 0.005
TREND_RECORDS, VOLUME_TIMES, TREND_ERRORS, ERROR_TIMES = 500, 2.0, 30, 3.0

COLUMNS = {
    "kind": "string", "from_ms": "bigint", "to_ms": "bigint", "count": "bigint", "factor": "double",
    "share": "double", "snippet": "string", "magnitude": "double",
}


def _insight(found: DataFrame, kind: str, **values: Column) -> DataFrame:
    values["kind"] = F.lit(kind)
    return found.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def robust_stats(bins: DataFrame, value: str = "n") -> DataFrame:
    """Median and median absolute deviation of the bins; of an even number, the upper middle one."""

    def middle(values: Column) -> Column:
        ranked = F.array_sort(values)
        return F.get(ranked, F.floor(F.size(ranked) / 2).cast("int"))

    gathered = bins.agg(F.collect_list(F.col(value).cast("double")).alias("all"))  # one number per bin
    return gathered.withColumn("median", middle(F.col("all"))).select(
        "median", middle(F.transform("all", lambda x: F.abs(x - F.col("median")))).alias("mad")
    )


def islands(bins: DataFrame, value: str, threshold: Column) -> DataFrame:
    """Runs of bins in a row above the threshold: first and last bin and sum."""
    above = bins.where(F.col(value) > threshold)
    run = F.col("bin") - F.row_number().over(Window.orderBy("bin"))  # at most one row per bin
    return (
        above.withColumn("_run", run).groupBy("_run")
        .agg(
            F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum(value).alias("sum"),
            F.first("from_ms").alias("from_ms"), F.first("width_ms").alias("width_ms"),
        )
        .drop("_run")
    )


def _run_times() -> dict[str, Column]:
    return {"from_ms": bin_start(F.col("first")), "to_ms": bin_start(F.col("last") + 1)}


def _run_length() -> Column:
    return F.col("last") - F.col("first") + 1


def _of(frame: DataFrame, column: str) -> Column:
    return frame.select(column).scalar()


def bursts(lines: DataFrame, filtered: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """The two largest runs of unusually full bins."""
    bins = bins720(lines, filtered) if bins is None else bins
    stats = robust_stats(bins)
    median, mad = _of(stats, "median"), _of(stats, "mad")
    mean = F.col("records_with_ts") / float(BINS)
    threshold = F.greatest(
        median + BURST_MAD * MAD_TO_SIGMA * mad, mean * BURST_MEAN, F.lit(BURST_FLOOR)
    )
    enough = bins.where(F.col("records_with_ts") >= 4 * BURST_RECORDS)
    runs = islands(enough, "n", threshold).where(F.col("sum") >= BURST_RECORDS)
    largest = runs.orderBy(F.desc("sum"), "first").limit(2)
    factor = F.col("sum") / _run_length() / F.greatest(F.lit(1.0), median)
    return _insight(largest, "Burst", **_run_times(), count=F.col("sum"), factor=factor, magnitude=F.col("sum"))


def error_spikes(lines: DataFrame, filtered: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """The two largest runs of bins with more errors than chance explains."""
    bins = bins720(lines, filtered) if bins is None else bins
    errors = _of(bins.agg(F.sum("errors").alias("errors")), "errors")
    expected = errors / float(BINS)
    threshold = F.greatest(F.lit(SPIKE_FLOOR), expected + SPIKE_SIGMA * F.sqrt(expected + 0.5))
    runs = islands(bins.where(errors >= SPIKE_ERRORS), "errors", threshold)
    largest = runs.orderBy(F.desc("sum"), "first").limit(2)
    factor = F.col("sum") / F.greatest(F.lit(1e-9), expected * _run_length())
    return _insight(largest, "ErrorSpike", **_run_times(), count=F.col("sum"), factor=factor, magnitude=F.col("sum"))


def document_facts(lines: DataFrame, filtered: bool = False) -> Column:
    """Number of records, records with a time, and time span, as one scalar subquery."""
    span = F.max("ts_ms") - F.min("ts_ms")
    facts = F.struct(F.count(F.lit(1)).alias("records"), F.count("ts_ms").alias("dated"), span.alias("span_ms"))
    return counted_records(lines, filtered).agg(facts.alias("facts")).scalar()


def _spam_templates(lines: DataFrame, filtered: bool, facts: Column | None) -> DataFrame:
    """Counts and times of the two most frequent templates that are spam, with their share."""
    facts = document_facts(lines, filtered) if facts is None else facts
    records, dated, span_ms = facts["records"], facts["dated"], facts["span_ms"]
    rate = F.when(span_ms > 0, dated * 1000.0 / span_ms).otherwise(0.0)
    length = F.col("last_ms") - F.col("first_ms")
    density = F.when(length > 0, F.col("records") * 1000.0 / length).otherwise(0.0)
    share = F.col("records") / records
    frequent = F.col("records") >= F.greatest(F.lit(SPAM_RECORDS).cast("bigint"), F.floor(records / SPAM_PART))
    dense = (density >= SPAM_PER_SEC) & ((rate <= 0) | (density >= SPAM_TIMES * rate))
    return top_k(template_counts(lines, filtered).where(frequent & ((share >= SPAM_SHARE) | dense)), 2).withColumn("share", share)


def spam(lines: DataFrame, filtered: bool = False, facts: Column | None = None) -> DataFrame:
    """The two most frequent templates that dominate the document or come in a dense stream."""
    found, share = _spam_templates(lines, filtered, facts), F.col("share")
    return _insight(
        found, "Spam", from_ms=F.col("first_ms"), to_ms=F.col("last_ms"), count=F.col("records"), share=share,
        snippet=template_display(F.col("template")), magnitude=F.col("records"),
    )


def spam_anchors(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """Where each spam begins: ``from_ms, snippet, level, example, first_file, first_entry`` of its first message."""
    found = pinned(_spam_templates(lines, filtered, None))  # at most two rows, read twice
    first = templates(lines, filtered, found.select("template", F.col("first_ms").alias("at")))
    details = first.select("template", "level", "example", "first_file", "first_entry")
    return found.join(F.broadcast(details), "template").select(
        F.col("first_ms").alias("from_ms"), template_display(F.col("template")).alias("snippet"), "level", "example", "first_file", "first_entry")


def silences(lines: DataFrame, filtered: bool = False, bucket_ms: int = 3_600_000) -> DataFrame:
    """All gaps between moments with records: ``(from_ms, to_ms, gap_ms)``.

    Records are reduced to their distinct moments.  Inside a bucket of time each moment looks back
    at the one before it; the first moment of a bucket looks at the last of the bucket before, which
    takes one row per bucket.
    """
    dated = counted_records(lines, filtered).where(F.col("ts_ms").isNotNull())
    moments = dated.groupBy("ts_ms").agg(F.lit(1).alias("one")).select("ts_ms", F.floor(F.col("ts_ms") / bucket_ms).alias("bucket"))
    inside = moments.select(F.lag("ts_ms").over(Window.partitionBy("bucket").orderBy("ts_ms")).alias("from_ms"), F.col("ts_ms").alias("to_ms"))
    ends = moments.groupBy("bucket").agg(F.min("ts_ms").alias("to_ms"), F.max("ts_ms").alias("last"))
    across = ends.select(F.lag("last").over(Window.orderBy("bucket")).alias("from_ms"), "to_ms")
    both = inside.unionByName(across).where(F.col("from_ms").isNotNull())
    return both.withColumn("gap_ms", F.col("to_ms") - F.col("from_ms"))


def gaps(lines: DataFrame, filtered: bool = False, facts: Column | None = None) -> DataFrame:
    """The two longest silences, if they are long for this document."""
    facts = document_facts(lines, filtered) if facts is None else facts
    length, n = facts["span_ms"], facts["dated"]
    shortest = F.greatest(
        F.lit(GAP_MS).cast("bigint"), (length / n * GAP_MEANS).cast("bigint"), (length * GAP_SPAN).cast("bigint")
    )
    longest = silences(lines, filtered).orderBy(F.desc("gap_ms"), "from_ms").limit(2)
    return _insight(
        longest.where(F.col("gap_ms") >= shortest), "Gap", from_ms=F.col("from_ms"), to_ms=F.col("to_ms"),
        magnitude=F.col("gap_ms"),
    )


def _halves(bins: DataFrame, value: str) -> DataFrame:
    early = F.col("bin") < BINS // 2
    enough = bins.where(F.col("records_with_ts") >= TREND_RECORDS)
    return enough.agg(
        F.sum(F.when(early, F.col(value))).alias("first"), F.sum(F.when(~early, F.col(value))).alias("second")
    )


def rising_volume(lines: DataFrame, filtered: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """The second half of the time span has at least twice the records of the first."""
    halves = _halves(bins720(lines, filtered) if bins is None else bins, "n")
    rising = halves.where((F.col("first") > 0) & (F.col("second") >= VOLUME_TIMES * F.col("first")))
    factor = F.col("second") / F.col("first")
    return _insight(rising, "RisingVolume", count=F.col("second"), factor=factor, magnitude=factor)


def rising_errors(lines: DataFrame, filtered: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """The second half of the time span has at least three times the errors of the first."""
    halves = _halves(bins720(lines, filtered) if bins is None else bins, "errors")
    first = F.greatest(F.lit(1).cast("bigint"), F.col("first"))
    rising = halves.where(
        (F.col("first") + F.col("second") >= TREND_ERRORS) & (F.col("second") >= ERROR_TIMES * first)
    )
    factor = F.col("second") / first
    return _insight(rising, "RisingErrors", count=F.col("second"), factor=factor, magnitude=factor)


def insights(lines: DataFrame, filtered: bool = False) -> DataFrame:
    """All insights, by kind and then by size; the first eight, numbered by ``rank``."""
    bins = pinned(bins720(lines, filtered))  # 720 rows, read by four of the six kinds
    facts = document_facts(lines, filtered)
    found = reduce(
        DataFrame.unionByName,
        [
            error_spikes(lines, filtered, bins), bursts(lines, filtered, bins), spam(lines, filtered, facts),
            gaps(lines, filtered, facts), rising_errors(lines, filtered, bins), rising_volume(lines, filtered, bins),
        ],
    )
    by_kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = Window.orderBy(by_kind, F.desc("magnitude"), "from_ms")  # at most two rows per kind
    return found.withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= MAX_INSIGHTS)
