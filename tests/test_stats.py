import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumberline.functions import text as T
from lumberline.functions.detect import classify
from lumberline.operators import directory, insights, stats
from lumberline.operators.records import assign_records

BASE = 1_780_000_000_000


def records(spark, rows):
    """Record heads from (ms, level, text)."""
    data = [("f", i + 1, i, None if ms is None else BASE + ms, lv, txt, ms is not None, ms is None and lv == 0)
            for i, (ms, lv, txt) in enumerate(rows)]
    return spark.createDataFrame(
        data, "file_path string, line_no bigint, logical_id bigint, ts_ms bigint, level int, text string, is_primary boolean, is_plain boolean")


def busy(seed=1):
    draw = random.Random(seed)
    rows = [(draw.randint(0, 10_000_000), draw.choice([3, 3, 3, 4, 5]), f"request {draw.randint(0, 9)} done") for _ in range(1500)]
    rows += [(6_000_000 + draw.randint(0, 30_000), 5, f"db {draw.randint(0, 99)} failed") for _ in range(300)]
    rows += [(9_900_000 + draw.randint(0, 90_000), 3, "tick") for _ in range(700)]
    return [r for r in rows if not 2_000_000 < r[0] < 2_400_000] + [(10_000_000, 3, "last"), (0, 3, "first")]


def bins_of(rows):
    times = [r[0] for r in rows if r[0] is not None]
    lo, width = min(times), (max(times) - min(times)) / 720.0
    at = [(min(719, int((ms - lo) / width)), lv) for ms, lv, _ in rows if ms is not None]
    return Counter(b for b, _ in at), Counter(b for b, lv in at if lv >= 5), lo, width


def runs(bins, threshold):
    out, start = [], None
    for b in range(721):
        if b < 720 and bins[b] > threshold:
            start = b if start is None else start
        elif start is not None:
            out.append((start, b - 1, sum(bins[i] for i in range(start, b))))
            start = None
    return sorted(out, key=lambda r: (-r[2], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_insights_against_brute_force(spark, seed):
    rows = busy(seed)
    frame = records(spark, rows).cache()
    total, errors, lo, width = bins_of(rows)
    got = {(r["bin"]): (r["n"], r["errors"]) for r in stats.bins720(frame).collect()}
    assert got == {b: (total[b], errors[b]) for b in range(720)}

    values = sorted(float(total[b]) for b in range(720))
    median = values[360]
    mad = sorted(abs(v - median) for v in values)[360]
    robust = insights.robust_stats(stats.bins720(frame)).first()
    assert (robust["median"], robust["mad"]) == (median, mad)

    n = len(rows)
    threshold = max(median + 6 * 1.4826 * mad, n / 720 * 3, 8)
    expected = [r for r in runs(total, threshold) if r[2] >= 50][:2]
    found = insights.bursts(frame).orderBy(F.desc("magnitude")).collect()
    assert [r["count"] for r in found] == [r[2] for r in expected] and expected
    assert [(r["from_ms"], r["to_ms"]) for r in found] == [
        (BASE + lo + int(a * width), BASE + lo + int((b + 1) * width)) for a, b, _ in expected]
    assert found[0]["factor"] == pytest.approx(expected[0][2] / (expected[0][1] - expected[0][0] + 1) / max(1, median))

    e = sum(errors.values()) / 720
    expected = runs(errors, max(5, e + 6 * math.sqrt(e + 0.5)))[:2]
    found = insights.error_spikes(frame).orderBy(F.desc("magnitude")).collect()
    assert [r["count"] for r in found] == [r[2] for r in expected] and expected

    times = sorted(r[0] for r in rows)
    gaps = sorted(((b - a, a, b) for a, b in zip(times, times[1:])), key=lambda g: (-g[0], g[1]))[:2]
    span = times[-1] - times[0]
    shortest = max(10_000, int(span / n * 50), int(span * 0.005))
    found = insights.gaps(frame).orderBy(F.desc("magnitude")).collect()
    assert [(r["magnitude"], r["from_ms"] - BASE) for r in found] == [(g[0], g[1]) for g in gaps if g[0] >= shortest]
    assert found

    kinds = [r["kind"] for r in insights.insights(frame).orderBy("rank").collect()]
    assert kinds == sorted(kinds, key=insights.KINDS.index) and len(kinds) <= 8


def test_equal_gaps_earlier_first(spark):
    rows = [(0, 3, "a"), (50_000, 3, "b"), (100_000, 3, "c"), (150_000, 3, "d"), (150_001, 3, "e")] + [(150_001, 3, "f")] * 600
    found = insights.gaps(records(spark, rows)).orderBy("from_ms").collect()
    assert [r["from_ms"] - BASE for r in found] == [0, 50_000]


def test_spam_needs_a_hundred(spark):
    for n, expected in ((99, 0), (100, 1)):
        rows = [(i, 3, f"tick {i}") for i in range(n)]
        found = insights.spam(records(spark, rows)).collect()
        assert len(found) == expected
    assert found[0]["share"] == 1.0 and found[0]["snippet"] == "tick #"


def test_trends(spark):
    rows = [(i * 10, 3, "a") for i in range(200)] + [(4000 + i * 5, 5, "b") for i in range(800)] + [(1, 5, "c")]
    frame = records(spark, rows)
    volume, errs = insights.rising_volume(frame).first(), insights.rising_errors(frame).first()
    total, errors, _, _ = bins_of(rows)
    first, second = sum(total[b] for b in range(360)), sum(total[b] for b in range(360, 720))
    assert volume["factor"] == pytest.approx(second / first) and volume["count"] == second
    assert errs["count"] == sum(errors[b] for b in range(360, 720))
    assert insights.rising_volume(frame.limit(10)).count() == 0


def test_single_moment_and_no_time(spark):
    one = records(spark, [(5, 3, "a")] * 3)
    assert stats.bins720(one).count() == 0 and insights.insights(one).count() == 0
    assert stats.timeline(one).collect()[0]["total"] == 3
    none = records(spark, [(None, 0, "a"), (None, 0, "b")])
    assert stats.totals(none).first().asDict() == {"lines": 2, "records": 2, "records_with_ts": 0}
    assert stats.rates(none).first()["avg_per_sec"] == 0.0 and stats.peak_rate(none).count() == 0
    assert stats.timeline(none).count() == 0


def test_last_record_is_in_the_last_bin(spark):
    frame = records(spark, [(0, 3, "a"), (7200, 5, "b"), (7190, 4, "c"), (10, 3, "d")])
    filled = {r["bin"]: r["n"] for r in stats.bins720(frame).collect() if r["n"]}
    assert filled == {0: 1, 1: 1, 719: 2}
    line = {r["bin"]: (r["total"], r["warn"], r["error"]) for r in stats.timeline(frame).collect()}
    assert line == {0: (1, 0, 0), 5: (1, 0, 0), 4090: (1, 1, 0), 4095: (1, 0, 1)}
    wide = {r["bin"]: r["total"] for r in stats.timeline(frame, from_ms=BASE - 7200, to_ms=BASE + 1).collect()}
    assert wide == {2048: 1, 2050: 1, 4093: 1, 4095: 1}


def test_timeline_derivatives(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 10**7), draw.choice([3, 4, 5, 6]), "x") for _ in range(2000)]
    line = stats.timeline(records(spark, rows)).cache()
    bins = {r["bin"]: r.asDict() for r in line.collect()}
    sums = {r["bin"]: r for r in stats.timeline_cumulative(line).collect()}
    assert sums[4095]["total_to"] == 2000 and len(sums) == 4096
    counted = stats.range_counts(stats.timeline_cumulative(line), 100, 2000).first()
    assert counted["error"] == sum(v["error"] for b, v in bins.items() if 100 <= b <= 2000)
    assert stats.range_counts(stats.timeline_cumulative(line), 0, 4095).first()["total"] == 2000
    for width in (7, 1000, 5000):
        columns = {r["x"]: r for r in stats.timeline_columns(line, width).collect()}
        assert len(columns) == width
        for x in (0, width // 3, width - 1):
            a, b = x * 4096 // width, (x + 1) * 4096 // width
            a, b = min(a, 4095), min(max(b, a + 1), 4096)
            assert columns[x]["total"] == sum(bins[i]["total"] for i in range(a, b) if i in bins)
        assert columns[0]["max_total"] == max(c["total"] for c in columns.values())


def test_peak_takes_the_first_of_equals(spark):
    rows = [(0, 3, "a"), (0, 3, "b"), (720_000, 3, "c"), (720_000, 3, "d")]
    peak = stats.peak_rate(records(spark, rows)).first()
    assert peak["bin"] == 0 and peak["peak_per_sec"] == 2.0 and peak["peak_to_ms"] == BASE + 1000


def test_templates(lines_of):
    texts = ["2026-07-10 09:00:01,000 INFO user 7 in", "2026-07-10 09:00:00,500 INFO user 12 in", "  more", "2026-07-10 09:00:02 ERROR x1f failed", "2026-07-10 09:00:03 INFO " + "w" * 500]
    log = assign_records(classify(lines_of(f=texts)))
    found = {r["template"]: r for r in stats.templates(log).collect()}
    user = found["#-#-# #:#:#,# INFO user # in"]
    assert user["records"] == 2 and user["example"] == texts[1] and user["first_entry"] == 1
    assert user["last_ms"] - user["first_ms"] == 500
    long = next(t for t in found if t.endswith("w" * 500))
    assert found[long]["example"] == texts[4]
    assert [r["template"] for r in stats.top_messages(log, 1).collect()] == [user["template"]]
    assert [r["share"] for r in stats.top_messages(log, 1).collect()] == [0.5]
    assert [r["template"] for r in stats.top_errors(log).collect()] == ["#-#-# #:#:# ERROR # failed"]


def test_filtered_view_counts_records(lines_of):
    texts = ["2026-07-10 09:00:01 WARN a", "  x", "  x", "2026-07-10 09:00:02 ERROR b", "  x", "2026-07-10 09:00:03 INFO c"]
    log = assign_records(classify(lines_of(f=texts)))
    view = log.where("text = '  x'")
    assert stats.totals(view, filtered=True).first().asDict() == {"lines": 3, "records": 2, "records_with_ts": 2}
    row = stats.file_breakdown(view, filtered=True).first()
    assert (row["records"], row["lines"], row["warn"], row["error"]) == (2, 3, 1, 1)
    assert {r["level"]: r["records"] for r in stats.level_counts(view, filtered=True).collect()} == {4: 1, 5: 1}
    assert stats.templates(view, filtered=True).first()["records"] == 2
    top = stats.top_messages(view, filtered=True).first()
    assert (top["template"], top["records"], top["first_entry"], top["share"]) == ("  x", 2, 0, 1.0)


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    durations = {0: "0 ms", 999: "999 ms", 12_345: "12 s", 270_000: "4 min 30 s", 3_900_000: "1 h 05 min", 540_000_000: "6 d 06 h"}
    assert {ms: one(T.duration_text(F.lit(ms))) for ms in durations} == durations
    day = 86_400_000
    assert one(T.range_text(F.lit(BASE), F.lit(BASE + 70_000))) == "20:26:40 – 20:27:50"
    assert one(T.range_text(F.lit(BASE), F.lit(BASE + day))) == "20:26:40 – 29.05 20:26:40"
    alerts = {(0, 0, 0): "—", (1, 2, 3): "1/2/3", (0, 3, 0): "/3/", (1, 0, 0): "1//"}
    assert {k: one(T.alert_text(*map(F.lit, k))) for k in alerts} == alerts
    assert one(T.ellipsis(F.lit("abcdef"), 3)) == "abc…" and one(T.ellipsis(F.lit("abc"), 3)) == "abc"
    norm = {"a1 b_2 3c d": "# # # d", "№5 x²y": "№# x²y", "192.168.0.1": "#.#.#.#", "0x1F-ab": "#-ab", "шаг2б ок": "# ок"}
    assert {k: one(T.normalize(F.lit(k))) for k in norm} == norm
    assert one(T.normalize(F.lit("x" * 401), 400)) == "x" * 400 + " …"
    assert one(T.normalize(F.lit("x" * 401 + "1"))) == "#"
    assert one(T.normalize(F.lit("y " * 300 + "a"))) != one(T.normalize(F.lit("y " * 300 + "b")))
    shown = {"#-# #:# INFO a": "INFO a", "# a # b": "# a # b", "": "", "# a\nbc": "bc"}
    assert {k: one(T.template_display(F.lit(k))) for k in shown} == shown


def test_directory(spark, lines_of):
    raw = lines_of(
        2, **{
            "/d/x/a.log": ["2026-07-10 09:00:05 INFO late first", "x WARN", "2026-07-10 09:00:01 ERROR", "FATAL FATAL"],
            "/d/y/b.log": ["no times", "error here"],
            "/d/y/C.log": ["2026-08-01 00:00:00", "warn"],
        })
    files = directory.scan_directory(classify(raw)).cache()
    rows = {r["file_path"]: r for r in files.collect()}
    a = rows["/d/x/a.log"]
    assert (a["lines"], a["warn"], a["error"], a["fatal"]) == (4, 1, 1, 1)
    assert a["first_ms"] - a["last_ms"] == 4000  # in the order of the file, not of time
    assert rows["/d/y/b.log"]["first_ms"] is None
    assert [r["file_path"] for r in directory.sort_files(files).collect()] == ["/d/x/a.log", "/d/y/b.log", "/d/y/C.log"]
    assert [r["file_path"] for r in directory.sort_files(files, "file_path", False).collect()] == ["/d/x/a.log", "/d/y/b.log", "/d/y/C.log"]

    def content(*args, **kw):
        return sorted(r["file_path"] for r in directory.filter_files_by_content(files, raw, *args, **kw).collect())

    assert content("ERROR") == ["/d/x/a.log", "/d/y/b.log"] and content("ERROR", case_sensitive=True) == ["/d/x/a.log"]
    assert content(r"^no\s", regex=True) == ["/d/y/b.log"] and content("([", regex=True) == []
    hits = directory.filter_files_by_content(files, raw, "warn")
    assert directory.content_match_summary(files, hits).first().asDict() == {"matched": 2, "files": 3}

    def dated(*window):
        return sorted(r["file_path"] for r in directory.filter_files_by_date(files, *window).collect())

    assert dated("2026-07-15 00:00:00", None) == ["/d/y/C.log", "/d/y/b.log"]
    assert dated(None, "2026-07-15 00:00:00") == ["/d/x/a.log", "/d/y/b.log"]
    tree = {r["path"]: (r["visible"], r["visible_files"]) for r in directory.directory_tree(files, F.col("error") > 0).collect()}
    assert tree["/d"] == (True, 2) and tree["/d/x"] == (True, 1) and tree["/d/y/C.log"] == (False, 0)
    bounds = directory.date_bounds(files).first()
    assert bounds["from_ms"] == a["first_ms"] and bounds["to_ms"] == rows["/d/y/C.log"]["last_ms"]
