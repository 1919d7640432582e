import json
import time

import pytest

from lumberline.operators import extract
from lumberline.plans.blocks import Block, Schema, SchemaError, problems, schema_from_json
from lumberline.plans.importers import PRESETS, schema_from_grok, schema_from_log4j, suggest_schema

CLASSIC = PRESETS["classic"]


def fields(spark, schema, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = extract.match_report(extract.extract_fields(rows, schema), schema).orderBy("id").collect()
    out = []
    for row in found:
        kept = {} if row["fields"] is None else {k: v for k, v in row["fields"].asDict().items() if v is not None}
        out.append((row["match"]["status"], kept))
    return out


def test_classic_lines(spark):
    found = fields(
        spark, CLASSIC,
        "2025-06-11 12:00:01.123 [quay] ERROR - rope torn",
        "2025-06-11 12:00:01   [quay]\tWARN  -  low tide",
        "\x01#~ 2025-06-11 12:00:01 [mole] INFO - moored",
        "2025-06-11 12:00:01 ?smudged? and so on",
        "    and one more rope",
        "2025-06-11 12:00:01 [mole] INFO lamp lit",
        "2025-06-11 12:00:01 [] INFO - nobody there",
        "2025-06-11 12:00:01 hull ERROR - leak found",
        "",
    )
    stamp = "2025-06-11 12:00:01"
    assert found == [
        ("full", {"Timestamp": stamp + ".123", "Thread": "quay", "Level": "ERROR", "Message": "rope torn"}),
        ("full", {"Timestamp": stamp, "Thread": "quay", "Level": "WARN", "Message": "low tide"}),
        ("full", {"Timestamp": stamp, "Thread": "mole", "Level": "INFO", "Message": "moored"}),
        ("partial", {"Timestamp": stamp, "Message": "?smudged? and so on"}),
        ("none", {}),
        ("full", {"Timestamp": stamp, "Thread": "mole", "Level": "INFO", "Message": "lamp lit"}),
        ("full", {"Timestamp": stamp, "Level": "INFO", "Message": "nobody there"}),
        ("partial", {"Timestamp": stamp, "Thread": "hull", "Level": "ERROR", "Message": "leak found"}),
        ("none", {}),
    ]


def test_hidden_blocks_are_no_fields(spark):
    blocks = list(CLASSIC.blocks)
    blocks[1] = Block("text", "Thread", leading="[", closing="]", hidden=True)
    (status, kept), = fields(spark, Schema(tuple(blocks)), "2025-06-11 12:00:01 [pilot 4] ERROR - fog")
    assert kept == {"Timestamp": "2025-06-11 12:00:01", "Level": "ERROR", "Message": "fog"}


def test_constants_and_separators(spark):
    dashes = Schema((Block("text", "A", separator="-{2,}", separator_regex=True), Block("remainder", "B")))
    assert fields(spark, dashes, "alpha --- beta") == [("full", {"A": "alpha", "B": "beta"})]
    quiet = Schema((Block("constant", pattern="REQ>"), Block("remainder", "Message")))
    assert fields(spark, quiet, "REQ> hello") == [("full", {"Message": "hello"})]
    named = Schema((Block("constant", "Marker", pattern="REQ>"), Block("remainder", "Message")))
    assert fields(spark, named, "REQ> hello") == [("full", {"Marker": "REQ>", "Message": "hello"})]
    glued = Schema((Block("text", "W", leading="[", closing="]", separator=":"), Block("remainder", "Message")))
    assert fields(spark, glued, "[w]: hello", "[w] hello") == [("full", {"W": "w", "Message": "hello"})] * 2


KERNEL = Schema(
    (
        Block("timestamp", "Time"), Block("hex", "Thread", leading="[", closing="]"), Block("text", "Logger", separator=" "),
        Block("level", "Level"), Block("text", "Message", separator="~~"), Block("text", "Function"),
        Block("path", "File", leading="{", separator=":"), Block("integer", "Line", closing="}"),
    ),
    line_prefix="> ",
)
KERNEL_LINE = (
    r"> 2024-11-02 06:40:09,015 [0x0a1b] Ferry.Berth INFO two ropes left ~~ "
    r"moor {Q:\quay\north\berth.rs:12}"
)


def test_long_schema_and_hostile_line(spark):
    (status, kept), = fields(spark, KERNEL, KERNEL_LINE)
    assert status == "full" and kept["Level"] == "INFO" and kept["Message"] == "two ropes left"
    assert kept["File"] == r"Q:\quay\north\berth.rs" and kept["Line"] == "12"
    hostile = KERNEL_LINE.split("{")[0] + "{Q:" + "\\pier" * 40 + ".rs:12"
    rows = spark.createDataFrame([(hostile,)] * 300, "text string")
    began = time.time()
    assert extract.match_report(rows, KERNEL).where("match.status = 'full'").count() == 0
    assert time.time() - began < 20


def test_noncharacters_do_not_disturb_other_control_characters(spark):
    (status, kept), = fields(spark, CLASSIC, "2025-06-11 12:00:01 [a\x01b] INFO - \x02x\x01")
    assert kept["Thread"] == "a\x01b" and kept["Message"] == "\x02x\x01"


def test_grok(spark):
    rx = r"%{TIMESTAMP_ISO8601:time} \[%{WORD:thread}\] %{LOGLEVEL:level} %{GREEDYDATA:msg}"
    assert fields(spark, schema_from_grok(rx), "2025-06-11 12:00:01 [main] INFO started ok") == [
        ("full", {"time": "2025-06-11 12:00:01", "thread": "main", "level": "INFO", "msg": "started ok"})
    ]
    schema = schema_from_grok(r"%{IP:client} %{WORD} %{GREEDYDATA:a} %{QS:q} %{STRANGE:s}")
    assert [b.kind for b in schema.blocks] == ["ip", "text", "greedy-text", "text", "text"]
    assert schema.field_names == ["client", "a", "q", "s"] and "STRANGE" in schema.warnings[0]
    assert (schema.blocks[3].leading, schema.blocks[3].closing) == (' "', '"')
    with pytest.raises(SchemaError):
        schema_from_grok("no tokens")


def test_log4j(spark):
    schema = schema_from_log4j("%d{ISO8601} [%t] %-5p %c - %m%n")
    assert schema.field_names == ["Timestamp", "Thread", "Level", "Logger", "Message"]
    assert fields(spark, schema, "2025-06-11 12:00:01,5 [main] WARN app.Main - hi") == [
        ("full", {"Timestamp": "2025-06-11 12:00:01,5", "Thread": "main", "Level": "WARN", "Logger": "app.Main", "Message": "hi"})
    ]
    assert schema_from_log4j("%d %p %m").field_names == ["Timestamp", "Level", "Message"]
    assert schema_from_log4j("100%% %m %q").blocks[0].separator == " %q"
    assert schema_from_log4j("100%% %m").line_prefix == "100% "


def test_validation(spark):
    bad = [
        Schema(()), Schema((Block("regex", "a", pattern="(["),)), Schema((Block("text", "a"), Block("text", "A"))),
        Schema((Block("remainder", "a"), Block("text", "b"))), Schema((Block("constant", "a"),)), Schema((Block("text", " "),)),
        Schema((Block("text", "a", separator="([", separator_regex=True),)),
    ]
    assert all(problems(s) for s in bad) and not problems(CLASSIC)
    with pytest.raises(SchemaError):
        extract.extract_fields(spark.createDataFrame([("x",)], "text string"), bad[1])


def test_schema_files(spark, tmp_path):
    old = {"version": 1, "blocks": [
        {"name": "Thread", "kind": "optional-text", "leadingText": "[", "separator": "]"},
        {"name": "Skip", "kind": "ignore", "separator": " "}, {"name": "Message", "kind": "remainder"}]}
    schema = schema_from_json(json.dumps(old))
    assert (schema.blocks[0].closing, schema.blocks[0].separator) == ("]", "")
    assert schema.field_names == ["Thread", "Message"]
    assert fields(spark, schema, "[worker-9] all good")[0][1] == {"Thread": "worker-9", "Message": "good"}
    with pytest.raises(SchemaError):
        schema_from_json(json.dumps({"version": 4, "blocks": old["blocks"]}))
    (tmp_path / "old.json").write_text(json.dumps(old))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "newer.json").write_text('{"version": 9, "blocks": []}')
    (tmp_path / "other.txt").write_text(json.dumps(old))
    assert list(extract.load_schemas(spark, str(tmp_path))) == ["old"]


def test_suggested_schemas():
    schema = suggest_schema("2025-06-11 12:00:01.123 [quay] ERROR - rope torn")
    assert [(b.kind, b.name) for b in schema.blocks] == [
        ("timestamp", "Timestamp"), ("text", "Thread"), ("level", "Level"), ("text", "Source"), ("remainder", "Message")]
    assert schema.blocks[2].separator == "-"
    schema = suggest_schema("10.0.0.1:80 (17) {deadbeef} <x> 42 Main: done")
    assert [b.kind for b in schema.blocks] == ["ip", "integer", "hex", "text", "integer", "text", "remainder"]
    assert suggest_schema("").field_names == ["Message"]
    assert suggest_schema("1 2 3").field_names == ["Number", "Number 2", "Number 3", "Message"]


def test_infer_and_best(spark):
    classic = [f"2025-06-11 12:00:0{i % 10} [w-{i}] INFO - message {i}" for i in range(30)]
    pipes = [f"a{i} | b | c | message {i}" for i in range(10)]
    rows = spark.createDataFrame([("x", t) for t in classic] + [("y", t) for t in pipes], "file_path string, text string")
    schema, ranking = extract.infer_schema(rows.where("file_path = 'x'"))
    assert [b.kind for b in schema.blocks][:3] == ["timestamp", "text", "level"]
    best = extract.best_schema(rows, {"classic": CLASSIC, "pipe": PRESETS["pipe"]}).collect()
    assert {r["file_path"]: (r["name"], r["full"]) for r in best} == {"x": ("classic", 30), "y": ("pipe", 10)}


def test_view_and_types(spark):
    rows = spark.createDataFrame([("2025-06-11 12:00:01,5 [w] INFO - hi",), ("junk",), ("2025-06-11 12:00:01 [] INFO -",)], "text string")
    found = extract.extract_fields(rows, CLASSIC)
    shown = [r["shown"] for r in extract.project_view(found, ["Message", "Thread", "Nope"]).collect()]
    assert shown == ["w hi", "junk", ""]
    typed = extract.typed_fields(found, CLASSIC).select("Timestamp").collect()
    assert str(typed[0][0]) == "2025-06-11 12:00:01.005000" and typed[1][0] is None


def test_one_pass_over_the_text(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    plan = extract.extract_fields(rows, CLASSIC)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?d)^") <= 2 * len(extract.variants(CLASSIC))


def test_hex_values_beyond_64_bits_are_null(spark):
    schema = Schema((Block("hex", "H", leading="[", closing="]"), Block("remainder", "Message")))
    rows = spark.createDataFrame([("[0xff] a",), ("[0x" + "f" * 40 + "] a",), ("[0x" + "0" * 30 + "1f] a",)], "text string")
    found = [r["H"] for r in extract.typed_fields(extract.extract_fields(rows, schema), schema).collect()]
    assert [None if v is None else int(v) for v in found] == [255, None, 31]


def test_infer_from_many_shapes(spark, monkeypatch):
    """Most lines have one format and wordings of their own; a smaller format repeats 20 messages."""
    letters = "abcdefghijklmnop"
    free = [f"2025-06-11 12:00:01 [w] INFO - {letters[i // 16]}{letters[i % 16]} rope torn" for i in range(200)]
    hot = [f"<{letters[i % 16] * (1 + i // 16)}> moored at the {letters[i % 16]} quay" for i in range(20)] * 3
    rows = spark.createDataFrame([(t,) for t in free + hot + [""]], "text string")
    schema, ranking = extract.infer_schema(rows)
    assert schema == suggest_schema(free[0])
    counts = {(r["full"], r["partial"], r["none"], r["blank"]) for r in ranking.collect()}
    assert (200, 0, 60, 1) in counts and ranking.count() == 2
    monkeypatch.setattr(extract, "RANKED_TOGETHER", 1)
    again, passes = extract.infer_schema(rows)
    assert again == schema and sorted(passes.collect()) == sorted(ranking.collect())


def test_suggested_schema_has_all_fields(spark):
    line = "2025-06-11 12:00:01 " + " ".join(map(str, range(30))) + " done now"
    schema = suggest_schema(line)
    assert [b.kind for b in schema.blocks] == ["timestamp"] + ["integer"] * 30 + ["text", "remainder"]
    found = dict(fields(spark, schema, line)[0][1])
    assert found["Number 30"] == "29" and found["Source"] == "done" and found["Message"] == "now"
    assert suggest_schema("2025-06-11 12:00:01 \r").field_names == ["Timestamp", "Message"]


def test_grok_query_over_all_lines(spark, tmp_path, monkeypatch):
    from lumberline.catalog import REGISTRY, fields as queries

    lines = ["2001-10-14 00:00:00,060 [w] INFO - part 1", "2001-10-14 00:00:00,061 w ERROR - part 2"]
    monkeypatch.setattr(queries.views, "thread_lines", lambda s, d: s.createDataFrame(list(enumerate(lines)), "seq int, text string"))
    found = {r["seq"]: (r["thread"], r["lv"], r["message"], r["status"]) for r in REGISTRY["X7_grok_all"].run(spark, str(tmp_path)).collect()}
    assert found == {0: ("w", "INFO", "part 1", "full"), 1: (None, None, "w ERROR - part 2", "partial")}


def test_lines_that_hold_markers(spark):
    """Fields come back as they stood, whatever noncharacters a line holds."""
    texts = [f"2026-07-10 09:00:00 [t{c}] ERROR - a{c}b {d}er" for c in ("", "\ufdd0", "\ufdd1\ufdd0", "\ufdd2\ufdd3\ufdd0") for d in ("", "\ufdd1", "\ufdd5")]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = extract.extract_preset(frame, "classic").orderBy("id").collect()
    for text, row in zip(texts, rows, strict=True):
        head, message = text.split("] ERROR - ")
        assert (row["fields"]["Thread"], row["fields"]["Level"], row["fields"]["Message"]) == (head.split("[")[1], "ERROR", message), text


def test_a_line_is_matched_and_trimmed_once(spark):
    rows = spark.createDataFrame([(" 2025-06-11 12:00:01 [\u2003quay\u00a0] ERROR -  rope\ufdd0torn ",)], "text string")
    found = extract.match_report(extract.extract_fields(rows, CLASSIC), CLASSIC)
    assert found.first()["fields"].asDict() == {
        "Timestamp": "2025-06-11 12:00:01", "Thread": "quay", "Level": "ERROR", "Message": "rope\ufdd0torn "}
    # What a step repeats runs for every cell of every line.
    plan = extract.extract_fields(rows, CLASSIC)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 1
    assert plan.count("regexp_replace(") == len(extract.variants(CLASSIC))
    assert plan.count("trim(") <= len(CLASSIC.blocks) + 2


def test_lines_that_differ_in_digits_suggest_once(spark, monkeypatch):
    lines = [
        "2025-06-11 12:00:01 INFO [net 7] 10.0.0.1:80 0x1F0 af30b9 count: 17",
        "12:00:01,5 <WARN> 0XAB 123456 9 {12} x0 0 00 0x 5.5 -3 : 8",
        "06/11/2025 9:00:00 a1b2c3d4 1.2.3.4 (0x00) 1e5 \u0663 no 0xZ",
    ]
    for line in lines:
        assert suggest_schema(extract.line_shape(line)) == suggest_schema(line)
    assert extract.line_shape("user 31 value=9.07") == extract.line_shape("user 20 value=1.55")
    rows = spark.createDataFrame([(f"2025-06-11 12:00:{i % 60:02} INFO user {i % 90 + 10}",) for i in range(500)], "text string")
    assert [r["n"] for r in extract.suggested_schemas(rows).collect()] == [500]
