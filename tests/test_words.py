import json
import random
import time

from pyspark.sql import functions as F

from lumberline.functions.detect import classify
from lumberline.functions.tokens import token_type
from lumberline.operators import payloads, tokens
from lumberline.operators.records import assemble_records, assign_records


def kinds(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    return [(r["type"], r["token"]) for r in tokens.tokens(frame, keys=[]).orderBy("pos").collect()]


CASES = {
    "ERROR WARNING WARN INFOS xINFO info _DEBUG [TRACE]": [
        ("level", "ERROR"), ("level", "WARNING"), ("level", "WARN"), ("level", "TRACE")],
    r'''say "a \" b" and 'c' "open''': [("string", r'"a \" b"'), ("string", "'c'")],
    "see https://x.y/z?q=1, (ftp://h/p). http:// end": [("url", "https://x.y/z?q=1"), ("url", "ftp://h/p")],
    r"at C:\Program Files (x86)\a.txt:324": [("path", r"C:\Program Files (x86)\a.txt"), ("number", "324")],
    "/usr/lib/x.so, /single ./a ./ab ../c": [("path", "/usr/lib/x.so"), ("path", "./ab"), ("path", "../c")],
    "2024-01-15T10:30:45.123Z|2024/01/15|10:30:45,5+02:00|10:30": [
        ("timestamp", "2024-01-15T10:30:45.123Z"), ("timestamp", "2024/01/15"), ("timestamp", "10:30:45,5+02:00"),
        ("number", "10"), ("number", "30")],
    "550e8400-e29b-41d4-a716-446655440000;{550e8400-e29b-41d4-a716-446655440000}": [
        ("guid", "550e8400-e29b-41d4-a716-446655440000"), ("guid", "{550e8400-e29b-41d4-a716-446655440000}")],
    "0xFF 0x 12ab34 12ab 123456 a1b2c3d4": [("hex", "0xFF"), ("raw_hex", "12ab34"), ("number", "123456")],
    "1 2.5 192.168.0.1 42. 1,234 abc-1 5x _6 .7 8.": [
        ("number", "1"), ("number", "2.5"), ("ip", "192.168.0.1"), ("number", "42"), ("number", "8")],
    "": [],
}


def test_tokens(spark):
    for text, expected in CASES.items():
        assert kinds(spark, text) == expected, text


def test_long_lines_need_no_deep_stack(spark):
    text = "/a/b" + " word" * 20_000 + ' "' + "x" * 200_000 + '" ' + "1 " * 50_000
    found = kinds(spark, text)
    assert found[0][0] == "path" and found[1] == ("string", '"' + "x" * 200_000 + '"') and len(found) == 50_002


def test_token_counts_and_tops(spark):
    frame = spark.createDataFrame([("http://a.b/1 7 http://a.b/2",), ("7 http://user@c.d:8080/x 10.0.0.1",)], "text string")
    assert {(r["type"], r["token"]): r["n"] for r in tokens.token_counts(frame).collect()}[("number", "7")] == 2
    assert [tuple(r) for r in tokens.top_tokens(frame, "host", 5).collect()] == [("a.b", 2), ("c.d", 1)]
    assert [tuple(r) for r in tokens.top_tokens(frame, "ip", 5).collect()] == [("10.0.0.1", 1)]


def test_token_type(spark):
    values = {"http://x/y": "url", "http://x y": "path", " 2024-01-31 12:34:56.789 ": "timestamp", "12:34:56": "timestamp",
              "31.01.2024 1:02:03": "timestamp", "2024-01-31": "none", "C:/x": "path", "a/b": "path", "a\\b": "path",
              "": "none", "a\nb/c": "none", "word": "none"}
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = {r["v"]: r["k"] for r in frame.select("v", token_type(F.col("v")).alias("k")).collect()}
    assert found == values


def balanced_end(text, start):
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def model_blocks(text):
    out, i = [], 0
    while i < len(text):
        if text[i] in "{[":
            end = balanced_end(text, i)
            if end > 0:
                try:
                    value = json.loads(text[i:end], parse_constant=int)  # NaN and the like are no JSON
                except ValueError:
                    value = None
                if isinstance(value, dict) and value or isinstance(value, list) and (
                        len(value) > 1 or value and isinstance(value[0], (dict, list, str))):
                    out.append(text[i:end])
                    i = end
                    continue
        i += 1
    return out


def test_json_blocks(spark):
    texts = [
        'ok {"a": {"b": [1, 2]}, "c": "}"} tail [8] {} ["x"]', "{broken {\"a\": 1} ] [1, 2", 'esc {"q": "a\\"}b"}', "none", "[[1]] {'x': 1} [NaN, 1]",
        "{" * 3000, '{"deep": ' + "[" * 200 + "1" + "]" * 200 + "}", "many " + '{"k": 1} ' * 100,
    ]
    draw = random.Random(7)
    texts += ["".join(draw.choice('{}[]",:1a\\ ') for _ in range(40)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {}
    for r in payloads.json_blocks(frame, ["id"]).collect():
        found.setdefault(r["id"], {})[r["block_no"]] = r["json"]
    for i, text in enumerate(texts):
        got = [found.get(i, {})[k] for k in sorted(found.get(i, {}))]
        assert got == model_blocks(text), text
    few = payloads.json_blocks(frame.where("id = 7"), ["id"], max_blocks=3)
    assert few.count() == 3


def test_json_keys(spark):
    frame = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [2]}}'), (2, '{"a": 1}'), (3, "[1, 2]")], "id int, json string")
    found = {r["key"]: (r["objects"], r["distinct_values"]) for r in payloads.json_keys(frame).collect()}
    assert found == {"a": (2, 1), "b": (1, 1)}
    values = {(r["id"], r["key"]): r["value"] for r in payloads.json_values(frame).collect()}
    assert values[(1, "b")] == '{"c":[2]}'


def test_json_of_long_records(spark, lines_of):
    """Blocks behind the size a record is shown with, blocks over many lines, and an open one at the end."""
    spread = ['{"k": [', *[f"  {i}," for i in range(50)], "  50", "]}"]
    texts = ["2026-07-10 09:00:00 INFO a", *[f"line {i}" for i in range(2500)], 'late {"a": 1} [1, 2]', *spread, "x" * 300_000 + ' {"b": 2}', "{", '"c"']
    texts += ["2026-07-10 09:00:01 INFO b", ': {"d": 1}', "2026-07-10 09:00:02 INFO c"]
    record = assign_records(classify(lines_of(64, f=texts, g=["plain [1, [2]] text"])))
    found = {(r["file_path"], r["first_line"], r["block_no"]): r["json"] for r in payloads.line_json_blocks(record).collect()}
    whole = ['{"a": 1}', "[1, 2]", "\n".join(spread), '{"b": 2}']
    assert found == {("f", 1, i): x for i, x in enumerate(whole)} | {("f", len(texts) - 2, 0): '{"d": 1}', ("g", 1, 0): "[1, [2]]"}
    assert payloads.line_json_blocks(record, max_blocks=2).where("file_path = 'f'").count() == 3
    text = assemble_records(record, max_lines=None, max_chars=None).where("file_path = 'f' and first_line = 1").first()
    assert text["text"] == "\n".join(texts[:-3]) and not text["truncated"]


def broken_texts(draw, n):
    values = [{"a": [1, {"b": "x\\\n"}], "c": {}}, [[], [1], {"d": None}], {"e": "}{"}, [8], [True, -1.5e3], ["[1, 2]"], {"f": "{\"g\": 1}"}]
    for _ in range(n):
        yield "".join(draw.choice('{{}}[]",:1-a\\ \n\n') for _ in range(60))
        text = "".join(json.dumps(draw.choice(values), indent=draw.choice([None, 1])) + draw.choice([" ", "\n", "{\n", "[ \n", '"', "[1,\n"]) for _ in range(4))
        cut = draw.randrange(len(text))
        yield text[:cut] + draw.choice(["", "\n", "}", "]", '"']) + text[cut:]


def test_json_line_by_line_as_at_once():
    for text in broken_texts(random.Random(11), 5000):
        assert payloads.find_json(text) == model_blocks(text), text


def test_json_takes_linear_time():
    def seconds(text):
        began = time.perf_counter()
        payloads.find_json(text)
        return time.perf_counter() - began

    for part in ('{"a":[', "[", '["[",', '{"a": "[1,2] ', "[1,\n", '{"a"\n:[\n', '["\\'):
        small, large = (min(seconds(part * n) for _ in range(3)) for n in (4_000, 32_000))
        assert large < 30 * small + 0.05, part


def test_json_of_records_over_blocks(spark, lines_of):
    """Blocks of a few lines cut payloads anywhere; the result is that of the whole text."""
    draw, files, want = random.Random(21), {}, set()
    for f, text in enumerate(broken_texts(draw, 150)):
        lines = [line for line in text.replace("\r", "").split("\n")]
        rows = ["2026-07-10 09:00:00 INFO a " + draw.choice(["", "[", '{"k":', "[[1],"]), *lines]
        if draw.random() < 0.4:
            at = draw.randrange(1, len(rows) + 1)
            rows.insert(at, "2026-07-10 09:00:01 INFO b ]")
        name = f"f{f:03}"
        files[name] = rows
        starts = [i for i, row in enumerate(rows) if row.startswith("2026")]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            want |= {(name, a + 1, k, found) for k, found in enumerate(model_blocks("\n".join(rows[a:b])))}
    for block in (1, 3, 1000):
        record = assign_records(classify(lines_of(block, **files)))
        assert {tuple(r) for r in payloads.line_json_blocks(record).collect()} == want


def test_json_of_a_view_that_lost_lines(lines_of):
    texts = ["2026-07-10 09:00:00 INFO a", "{", '"a": [1,', "lost", "2]", "}", "end"]
    view = assign_records(classify(lines_of(2, f=texts))).where("text <> 'lost' and line_no > 1")
    assert [tuple(r) for r in payloads.line_json_blocks(view).collect()] == [("f", 2, 0, '{\n"a": [1,\n2]\n}')]


def test_brackets_that_nothing_closes_are_not_decoded(monkeypatch):
    """Each refusal of the decoder takes time linear in the text before it."""
    tried = []
    decode = payloads._DECODE
    monkeypatch.setattr(payloads, "_DECODE", lambda text, at: tried.append(at) or decode(text, at))
    assert payloads.find_json('{"a": "[1,2] ' * 500) == ["[1,2]"] * 500
    assert len(tried) == 500
    assert payloads.find_json('x {"a": 1, [3, 4] } {"b": [1]} {') == ["[3, 4]", '{"b": [1]}']
