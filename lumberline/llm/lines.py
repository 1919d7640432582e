"""Site-relative line frequency: lines on too great a share of a host's pages are boilerplate.

Pages are the distinct texts of a host, so that copies of one page do not make its lines
boilerplate.  A line counts once per page.  Lines on more than ``ratio`` of the pages of a host and
on ``least_pages`` at least are dropped from all its pages; blank lines stay.

Nulls: documents without a host, and null texts, come back as they are and count nowhere.  Empty texts
stay empty.  Repeated rows are rows of their own.  Output names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO, LEAST_PAGES = 0.1, 5
#: Hosts whose boilerplate lines take no more than this travel as a broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 32


def _line_key(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, line, pages, host_pages)`` of the lines over the ratio; ``line`` is a digest."""
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").cast("string").alias("body")).where("host is not null and body is not null")
    keyed = pages.withColumn("page", F.md5(F.col("body").cast("binary")))
    # Two steps each: first one row per (host, page), so that a host with most pages is spread over all tasks.
    totals = keyed.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_pages"))
    wanted = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"\S"))
    lines = keyed.select("host", "page", F.explode(F.array_distinct(F.transform(wanted, _line_key))).alias("line"))
    counts = lines.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") >= least_pages).join(totals, "host").where(F.col("pages") > F.col("host_pages") * F.lit(ratio))


def drop_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The documents with the lines dropped from ``text``, and ``n_lines`` and ``n_dropped``."""
    from lumberline.llm.common import staged

    found = staged(boilerplate(docs, host=host, text=text, ratio=ratio, least_pages=least_pages), "boilerplate")
    size = found.count() * 80
    # A host has at most (lines per page / ratio) such lines, whatever its number of pages.
    by_host = found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__bad"))
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    keyed = plain.withColumn("__host", F.col(f"`{host}`"))
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(by_host), "__host", "left")
    else:
        salted = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    lines = F.split(F.col(f"`{text}`").cast("string"), "\n")
    bad = F.coalesce(F.col("__bad"), F.array().cast("array<string>"))
    split = joined.withColumn("__lines", lines)
    kept = F.filter("__lines", lambda x: ~(x.rlike(r"\S") & F.array_contains(bad, _line_key(x))))
    cleaned = split.withColumn("__kept", F.when(F.size(bad) == 0, F.col("__lines")).otherwise(kept))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    return cleaned.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in plain.columns],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n - F.size("__kept")).cast("long").alias("n_dropped"),
    )


def drop_boilerplate_sql(docs: str = "documents", ratio: float = RATIO, least_pages: int = LEAST_PAGES, select: str = "*") -> str:
    """The same in SQL: common table expressions that end with ``lined`` (the columns of ``docs``, the new text and the counts)."""
    return rf"""
numbered AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
host_pages AS (SELECT source, count(DISTINCT text) AS host_pages FROM {docs} WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source),
page_lines AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE source IS NOT NULL AND text IS NOT NULL),
bad AS (SELECT source, line FROM page_lines JOIN host_pages USING (source) WHERE regexp_matches(line, '\S')
  GROUP BY source, line, host_pages HAVING count(*) >= {least_pages} AND count(*) > host_pages * {ratio}),
lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered),
marked AS (SELECT l.rid, l.line, l.pos, b.line IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.line = b.line),
joined AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS new_text, count(*) AS n_lines,
  count(*) FILTER (dropped) AS n_dropped FROM marked GROUP BY rid),
lined AS (SELECT n.* EXCLUDE (rid, text), j.new_text AS text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped
  FROM numbered n LEFT JOIN joined j USING (rid))"""
