import random
import re

import pytest
from pyspark.sql import functions as F

from lumberline.functions.detect import classify
from lumberline.functions.rules import Rule, highlight_rules, rules_from_json, rules_to_column
from lumberline.operators import filters, marks, order
from lumberline.operators.documents import drop_file, merge_logs, source_count
from lumberline.operators.filters import FilterSpec
from lumberline.operators.records import (
    RECORD_CHARS, RECORD_LINES, assemble_records, assign_records, mark_new, record_chunks, record_fields, record_headers, record_heads,
)

LEVELS = ["INFO", "WARN", "ERROR", "FATAL", "DEBUG"]


def make_log(draw, n, start=0):
    texts = ["opening line"] if draw.random() < 0.5 else []
    ms = start
    while len(texts) < n:
        ms += draw.choice([0, 0, 1, 500, 90_000, 7_200_000])
        second, milli = divmod(ms, 1000)
        clock = f"{second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d},{milli:03d}"
        texts.append(f"2026-07-{10 + second // 86400:02d} {clock} {draw.choice(LEVELS)} message {draw.randint(0, 9)}")
        texts += ["    at x"] * draw.choice([0, 0, 1, 3])
    return texts


@pytest.fixture(scope="module")
def log(spark):
    draw = random.Random(11)
    rows = []
    for name in ("a", "b", "c"):
        texts = make_log(draw, 120) if name != "c" else ["plain one", "", "plain two"]
        rows += [(name, i // 16, i, t) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "file_path string, block bigint, seq bigint, text string")
    return assign_records(classify(raw)).cache()


@pytest.fixture(scope="module")
def rows(log):
    found = [r.asDict() for r in log.collect()]
    return sorted(found, key=lambda r: (r["ts_ms"] is None, r["ts_ms"] or 0, r["file_path"], r["logical_id"], r["line_no"]))


def keys(frame):
    return sorted((r["file_path"], r["line_no"]) for r in frame.collect())


def keys_of(rows):
    return sorted((r["file_path"], r["line_no"]) for r in rows)


def test_order_and_row_numbers(log, rows):
    expected = [(r["file_path"], r["line_no"]) for r in rows]
    assert [(r["file_path"], r["line_no"]) for r in order.ordered(log).collect()] == expected
    numbered = order.with_row_no(log).orderBy("row_no").collect()
    assert [(r["file_path"], r["line_no"]) for r in numbered] == expected
    assert [r["row_no"] for r in numbered] == list(range(len(rows)))
    assert [r["text"] for r in order.sample_lines(log, 5).collect()] == [r["text"] for r in rows if r["text"].strip()][:5]


def test_level_and_time_filters(log, rows):
    assert keys(filters.filter_levels(log, ["warning", "FATAL"])) == keys_of(r for r in rows if r["level"] in (4, 6))
    assert filters.filter_levels(log, []) is log
    times = [r["ts_ms"] for r in rows if r["ts_ms"] is not None]
    lo, hi = times[20], times[-30]
    inside = [r for r in rows if r["ts_ms"] is not None and lo <= r["ts_ms"] <= hi]
    assert keys(filters.filter_time(log, lo, hi)) == keys_of(inside)
    assert keys(filters.filter_time(log, None, hi)) == keys_of(r for r in rows if r["ts_ms"] is None or r["ts_ms"] <= hi)
    assert keys(filters.filter_time(log, lo)) == keys_of(r for r in rows if r["ts_ms"] is not None and r["ts_ms"] >= lo)
    assert filters.filter_time(log, hi, lo) is log
    assert filters.filter_time(log, lo, lo, picked=True) is log
    assert filters.filter_time(log, times[0], times[-1], picked=True).count() == len(rows)
    assert keys(filters.filter_time(log, lo, hi, picked=True)) == keys_of(inside)
    assert filters.to_ms("1970-01-02T00:00:00.005") == 86_400_005


def passes(spark, rules, *texts, fields=None):
    frame = spark.createDataFrame(list(texts), "text string") if fields is None else fields
    columns = {n: F.col("fields")[n] for n in ("Kind", "User")} if fields is not None else None
    condition = rules_to_column(rules, F.col("text"), columns)
    return None if condition is None else [r[0] for r in frame.select(condition).collect()]


def test_rule_precedence(spark):
    a, b, c = Rule("A", case_sensitive=True), Rule("B", case_sensitive=True), Rule("C", connector="or", case_sensitive=True)
    texts = [("A",), ("AB",), ("C",), ("B",), ("BC",)]
    assert passes(spark, [a, b, c], *texts) == [False, True, True, False, True]
    off = Rule("x", connector="or", enabled=False)
    assert passes(spark, [a, off, b], *texts) == [False, True, False, False, False]
    broken = Rule("([", regex=True, connector="or")
    assert passes(spark, [a, broken, b], *texts) == [False, True, False, False, False]
    assert passes(spark, [c, b], *texts) == [False, False, False, False, True]  # the first connector joins nothing
    assert passes(spark, [broken, Rule("")], *texts) is None
    assert passes(spark, [Rule("a", action="exclude")], *texts) == [False, False, True, True, True]


def test_field_rules(spark):
    schema = "text string, fields struct<Kind: string, User: string>"
    frame = spark.createDataFrame([("click by 7", ("click", "7")), ("at x", None), ("view", ("view", None))], schema)
    assert passes(spark, [Rule("click", field="Kind")], fields=frame) == [True, False, False]
    assert passes(spark, [Rule("click", field="Kind", action="exclude")], fields=frame) == [False, True, True]
    assert passes(spark, [Rule("7", field="User", regex=True, action="exclude")], fields=frame) == [False, True, True]
    assert passes(spark, [Rule("x", field="Unknown")], fields=frame) == [False, True, False]


def test_regex_rules_see_only_newlines_as_line_ends(spark):
    assert passes(spark, [Rule("^a.b$", regex=True)], ("a\rb",), ("a\u2028b",), ("a\nb",), ("A.B",)) == [True, True, False, True]


def test_rules_from_json():
    rules = rules_from_json('{"caseSensitive": true, "rules": [{"text": "x", "action": "exclude"}, {"text": "y", "highlight": false}]}')
    assert all(r.case_sensitive for r in rules) and rules[0].action == "exclude"
    assert highlight_rules(rules + [Rule("z", field="f")]) == [Rule("z")]


def test_all_filters_and_search(log, rows):
    spec = FilterSpec(levels=["ERROR", "FATAL"], rules=[Rule("MESSAGE 1"), Rule("at x", connector="or")])
    kept = [r for r in rows if r["level"] >= 5 and ("message 1" in r["text"] or "at x" in r["text"])]
    assert keys(filters.apply_filters(log, spec)) == keys_of(kept)
    view = filters.filter_levels(log, ["ERROR", "FATAL"])
    seen = [r for r in rows if r["level"] >= 5]
    hits = [i for i, r in enumerate(seen) if "message 1" in r["text"]]
    assert sorted(r["row_no"] for r in filters.search(view, [Rule("message 1")]).collect()) == hits
    assert filters.search(view, [Rule("([", regex=True)]).count() == 0
    assert filters.filter_rules(view, [Rule("([", regex=True)]).count() == len(seen)


def test_seek_time_and_error(spark, log, rows):
    dated = [r for r in rows if r["ts_ms"] is not None]
    lo, hi = dated[0]["ts_ms"], dated[-1]["ts_ms"]
    draw = random.Random(3)
    ats = [lo - 5, lo, hi, hi + 1] + [draw.randint(lo, hi) for _ in range(60)] + [r["ts_ms"] + d for r in dated[::9] for d in (0, 1)]
    probes = spark.createDataFrame(list(enumerate(ats)), "probe bigint, at bigint")
    for width in (1000, 3_600_000):
        by_time = {r["probe"]: (r["file_path"], r["line_no"]) for r in order.seek_time(log, probes, width).collect()}
        by_error = {r["probe"]: (r["file_path"], r["line_no"]) for r in order.seek_error(log, probes, width).collect()}
        for probe, at in enumerate(ats):
            row = next((i for i, r in enumerate(rows) if r["ts_ms"] is None or r["ts_ms"] >= at), None)
            assert by_time[probe] == (rows[row]["file_path"], rows[row]["line_no"])
            before = next((i for i in range(row, -1, -1) if rows[i]["level"] >= 4 and rows[i]["ts_ms"] is not None), None)
            after = next((i for i in range(row + 1, len(rows)) if rows[i]["level"] >= 4), None)
            pick = before if after is None else after if before is None else (
                before if abs(rows[before]["ts_ms"] - at) <= abs(rows[after]["ts_ms"] - at) else after)
            assert by_error[probe] == (rows[pick]["file_path"], rows[pick]["line_no"]), at


def test_seek_without_errors(spark, log):
    quiet = log.where("level < 4 and ts_ms is not null")
    probes = spark.createDataFrame([(1, 0)], "probe bigint, at bigint")
    assert order.seek_error(quiet, probes).select("line_no").collect() == order.seek_time(quiet, probes).select("line_no").collect()


@pytest.mark.parametrize("start", [-1, 0, 17, 60, 10_000])
def test_find(log, rows, start):
    hits = [i for i, r in enumerate(rows) if "message 3" in r["text"]]
    ahead, behind = [i for i in hits if i > start], [i for i in hits if i < start]
    inside = 0 <= start < len(rows)
    expected = ahead[0] if ahead else next(iter(i for i in hits if i <= start), None)
    assert order.find_next(log, "MESSAGE 3", start).first()[0] == expected
    assert order.find_next(log, "MESSAGE 3", start, wrap=False).first()[0] == (ahead[0] if ahead else None)
    back = (behind[-1] if behind else hits[-1]) if inside else hits[-1]
    assert order.find_previous(log, "MESSAGE 3", start).first()[0] == back
    assert order.find_next(log, "message 3", start, case_sensitive=True).first()[0] == expected
    assert order.find_next(log, "no such text", start).first()[0] is None


def test_locate_records(spark, log, rows):
    records = sorted({(r["file_path"], r["logical_id"]) for r in rows})
    wanted = spark.createDataFrame([(i, *k) for i, k in enumerate(records)], "probe bigint, file_path string, logical_id bigint")
    found = {r["probe"]: (r["file_path"], r["line_no"]) for r in order.locate_records(log, F.col("level") == 6, wanted, 16).collect()}
    for probe, key in enumerate(records):
        mine = [i for i, r in enumerate(rows) if (r["file_path"], r["logical_id"]) == key]
        shown = [i for i, r in enumerate(rows) if r["level"] == 6]
        own = [i for i in mine if i in shown]
        later, earlier = [i for i in shown if i > mine[0]], [i for i in shown if i < mine[0]]
        pick = own[0] if own else later[0] if later else earlier[-1]
        assert found[probe] == (rows[pick]["file_path"], rows[pick]["line_no"])


def test_records(spark, log, rows):
    texts = {(r["file_path"], r["first_line"]): (r["text"], r["n_lines"]) for r in assemble_records(log).collect()}
    expected = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], r["line_no"])):
        key = (r["file_path"], r["logical_id"], r["line_no"] if r["is_plain"] else 0)
        expected.setdefault(key, []).append(r)
    assert texts == {(v[0]["file_path"], v[0]["line_no"]): ("\n".join(x["text"] for x in v), len(v)) for v in expected.values()}
    heads = record_headers(log).collect()
    assert {(r["file_path"], r["first_line"]): (r["last_line"], r["entry_no"]) for r in heads} == {
        (v[0]["file_path"], v[0]["line_no"]): (v[-1]["line_no"], None if v[0]["is_plain"] else v[0]["logical_id"])
        for v in expected.values()}
    assert keys(record_heads(log)) == keys_of(v[0] for v in expected.values())
    assert keys(record_heads(log, filtered=True)) == keys_of(v[0] for v in expected.values())
    stack = log.where("text = '    at x'")
    assert keys(record_heads(stack, filtered=True)) == keys_of(
        next(x for x in v if x["text"] == "    at x") for v in expected.values() if any(x["text"] == "    at x" for x in v))


def test_endless_record_is_cut(lines_of):
    texts = ["2026-07-10 09:00:00 INFO a"] + [f"line {i}" for i in range(30)]
    record = assign_records(classify(lines_of(4, f=texts)))
    row = assemble_records(record, max_lines=5).first()
    assert row["text"].split("\n") == texts[:5] and row["truncated"] and row["n_lines"] == 31
    assert not assemble_records(record).first()["truncated"]
    assert assemble_records(record, max_chars=10).first()["text"] == "2026-07-10"


def test_long_record_is_whole_and_its_head_is_asked_for(lines_of):
    texts = ["2026-07-10 09:00:00 INFO a"] + [f"line {i}" for i in range(4999)]
    record = assign_records(classify(lines_of(4, f=texts)))
    row = assemble_records(record).first()
    assert row["n_lines"] == 5000 == record_headers(record).first()["n_lines"] and not row["truncated"]
    assert row["text"] == "\n".join(texts)
    head = assemble_records(record, RECORD_LINES, RECORD_CHARS).first()
    assert head["n_lines"] == 5000 and head["truncated"] and head["text"] == "\n".join(texts[:RECORD_LINES])


def test_heads_at_any_limit(lines_of):
    texts = ["2026-07-10 09:00:00 INFO a", "", "", "bcd", "e" * 9, "", "2026-07-10 09:00:01 INFO second", "", "x"]
    for block in (1, 2, 4, 20):
        record = assign_records(classify(lines_of(block, f=texts, g=["free", "text 12"]))).cache()
        for lines in (None, 1, 2, 3, 6, 7):
            for chars in (None, 1, 26, 27, 28, 40, 300):
                found = {(r["file_path"], r["first_line"]): r for r in assemble_records(record, lines, chars).collect()}
                for first, own in ((1, texts[:6]), (7, texts[6:])):
                    kept = "\n".join(own[:lines])
                    row = found["f", first]
                    cut = len(own) > (lines or 99) or len(kept) > (chars or 999)
                    assert (row["text"], row["n_lines"], row["truncated"]) == (kept[:chars], len(own), cut)
                assert found["g", 2]["text"] == "text 12"[:chars]
        record.unpersist()


def test_chunks_make_up_the_record(lines_of):
    draw = random.Random(3)
    for block in (1, 3, 50):
        texts = ["opening"] * 2
        for _ in range(40):
            texts += ["2026-07-10 09:00:00 INFO a", *["y" * draw.choice([0, 0, 1, 7, 30]) for _ in range(draw.choice([0, 1, 2, 20]))]]
        log = assign_records(classify(lines_of(block, f=texts, g=["z" * 25, ""]))).cache()
        whole = {(r["file_path"], r["first_line"]): (r["text"], r["n_lines"]) for r in assemble_records(log).collect()}
        for size in (1, 8, 1000):
            chunks = {}
            for r in record_chunks(log, size).collect():
                chunks.setdefault((r["file_path"], r["first_line"]), []).append((r["chunk_no"], r["text"], r["n_lines"]))
            assert set(chunks) == set(whole)
            for key, found in chunks.items():
                found.sort()
                assert [n for n, _, _ in found] == list(range(len(found)))
                assert all(len(text) == size for _, text, _ in found[:-1]) and len(found[-1][1]) <= size
                assert ("".join(t for _, t, _ in found), sum(n for _, _, n in found)) == whole[key]
        log.unpersist()


def test_record_fields_and_new_rows(spark):
    schema = "file_path string, logical_id bigint, line_no bigint, is_plain boolean, ingest_batch int, fields struct<a: string>"
    frame = spark.createDataFrame([("f", 1, 1, False, 1, None), ("f", 1, 2, False, 2, ("x",)), ("f", 1, 3, False, 2, ("y",))], schema)
    assert record_fields(frame).first()["fields"]["a"] == "x"
    assert [r["is_new"] for r in mark_new(frame).orderBy("line_no").collect()] == [False, True, True]


def test_documents(log, rows):
    merged = merge_logs(log, log, log.where("file_path = 'a'"))
    assert merged.count() == len(rows) and merged.columns == log.columns
    other = log.where("file_path <> 'a'").withColumn("text", F.lit("other")).drop("ts")
    both = merge_logs(log.where("file_path = 'a'"), other, log)
    assert both.count() == len(rows)
    assert both.where("file_path <> 'a' and (text <> 'other' or ts is not null)").count() == 0
    assert keys(drop_file(log, "a")) == keys_of(r for r in rows if r["file_path"] != "a")
    assert source_count(log).first().asDict() == {"files": 3, "badge": True}


def test_markers_and_spans(spark):
    texts = ["foo bar foo", "xfoo foox foo", "FOO", "", "aaaa", "bar"]
    frame = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_path string, line_no int, text string")
    patterns = [Rule(r"\bfoo\b", regex=True, case_sensitive=True, color="red"), Rule("aa", color="blue"),
                Rule("b*", regex=True, color="green"), Rule("([", regex=True, color="bad"), Rule("foo", enabled=False, color="off")]
    marked = [r["marker"] for r in marks.mark_rows(frame, patterns).orderBy("line_no").collect()]
    assert marked == ["red", "red", "green", "green", "blue", "green"]
    spans = sorted((r["line_no"], r["pattern"], r["start"], r["length"]) for r in marks.match_spans(frame, patterns).collect())
    assert spans == [(0, 0, 0, 3), (0, 0, 8, 3), (0, 2, 4, 1), (1, 0, 10, 3), (4, 1, 0, 2), (4, 1, 2, 2), (5, 2, 0, 1)]
    counts = {r["pattern"]: (r["lines"], r["matches"]) for r in marks.match_counts(frame, patterns[:2]).collect()}
    assert counts == {0: (2, 3), 1: (1, 2)}
    assert marks.match_spans(frame, [Rule("([", regex=True)]).count() == 0


def test_spans_of_hostile_lines(spark):
    """Lines that hold the markers of the matcher, and very many matches in a line."""
    texts = ["ERROR - a\ufdd1b er \ufdd0er", "er" * 20_000, "", "x", "\ufdd0" * 5 + "er\ufdd1" + "\ufdd2\ufdd3er"]
    frame = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_path string, line_no int, text string")
    patterns = [Rule("er", case_sensitive=True), Rule("\ufdd1", case_sensitive=True), Rule("r.", regex=True, case_sensitive=True)]
    found = {(r["line_no"], r["pattern"], r["start"], r["length"]) for r in marks.match_spans(frame, patterns).collect()}
    expected = set()
    for i, text in enumerate(texts):
        for p, rx in enumerate(("er", "\ufdd1", "r.")):
            expected |= {(i, p, m.start(), m.end() - m.start()) for m in re.finditer(rx, text)}
    assert found == expected


def test_an_event_is_rendered_once(spark, tmp_path):
    """A step that repeats the rendering is too long for Java to compile."""
    from lumberline.sources import views

    rows = [(1, "2024-01-01 08:00:00", 5, "error", 250.0, "{}"), (2, "2024-01-01 08:00:01", 6, "view", 1.0, "{}")]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    lines = views.event_lines(spark, str(tmp_path))
    texts = [r["text"] for r in lines.orderBy("file_path", "seq").collect()]
    assert [t[24:] for t in texts if t.startswith("2024")] == ["FATAL [error] user 5 value=250.00 props={}", "INFO [view] user 6 value=1.00 props={}"]
    assert len(texts) == 6 and "    at app.Events.handle(Events.java:5)" in texts
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("] user ") == 1
