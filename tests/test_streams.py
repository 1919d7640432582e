import random

import pytest
from model import group
from pyspark.sql import functions as F
from test_detect import GOLDEN

from lumberline.functions.detect import classify
from lumberline.functions.rules import Rule
from lumberline.operators.filters import FilterSpec
from lumberline.operators.records import assign_records
from lumberline.sources.storage import range_lines
from lumberline.streaming import appended, live, tail

SCHEMA = "file_path string, generation bigint, seq bigint, text string, terminated boolean"
SHOWN = ["file_path", "line_no", "text", "logical_id", "ts_ms", "level", "provisional"]


def shown(table):
    return sorted((tuple(r) for r in table.lines().select(*SHOWN).collect()), key=lambda r: r[:2])


@pytest.fixture
def table(spark, tmp_path):
    return tail.LogTable(spark, str(tmp_path / "tail"))


def put(spark, table, batch_id, *rows):
    tail.append_batch(table, spark.createDataFrame(list(rows), SCHEMA), batch_id)


def test_batches_equal_one_load(spark, table):
    cuts = [0, 1, 5, 10]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # Rows of one file arrive in any order within a batch.
        put(spark, table, n, *[("f", 0, i, GOLDEN[i], True) for i in reversed(range(a, b))])
    assert [(r[3], r[4], r[5]) for r in shown(table)] == group(GOLDEN)
    assert [r[1] for r in shown(table)] == list(range(1, 11))


def test_unfinished_line_is_completed(spark, table):
    put(spark, table, 0, ("f", 0, 0, "2026-07-10 12:00:00,000 INFO a", True), ("f", 0, 1, "2026-07-10 12:00:01,000 ERROR half-writ", False))
    before = shown(table)
    assert [(r[2][-9:], r[5], r[6]) for r in before] == [(",000 INFO a"[-9:], 3, False), ("half-writ", 5, True)]
    put(spark, table, 1, ("f", 0, 2, "ten timeout", True), ("f", 0, 3, "    at x", True))
    after = shown(table)
    assert [r[2] for r in after] == ["2026-07-10 12:00:00,000 INFO a", "2026-07-10 12:00:01,000 ERROR half-written timeout", "    at x"]
    assert [(r[3], r[5], r[6]) for r in after] == [(0, 3, False), (1, 5, False), (1, 5, False)]


def test_pieces_over_several_batches(spark, table):
    for n, (text, closed) in enumerate([("a", False), ("b", False), ("c", True)]):
        put(spark, table, n, ("f", 0, n, text, closed))
    assert [(r[1], r[2], r[6]) for r in shown(table)] == [(1, "abc", False)]


def test_replaced_file_starts_afresh(spark, table):
    put(spark, table, 0, ("f", 0, 0, "2026-07-10 12:00:00 INFO old", True), ("g", 0, 0, "g1", True), ("f", 0, 1, "tail", False))
    put(spark, table, 1, ("f", 1, 0, "new", True))
    put(spark, table, 2, ("f", 0, 9, "late row of the old file", True), ("g", 0, 1, "g2", True))
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in shown(table)] == [
        ("f", 1, "new", 0, 0), ("g", 1, "g1", 0, 0), ("g", 2, "g2", 0, 0)]


def test_a_batch_that_runs_again_changes_nothing(spark, table):
    first = ("f", 0, 0, "2026-07-10 12:00:00 INFO a", True)
    second = [("f", 0, 1, "more", True), ("f", 0, 2, "piece", False)]
    put(spark, table, 0, first)
    put(spark, table, 1, *second)
    once = shown(table)
    put(spark, table, 1, *second)
    assert shown(table) == once


def test_empty_batches_keep_the_state(spark, table):
    put(spark, table, 0, ("f", 0, 0, "2026-07-10 12:00:00 INFO a", True))
    tail.append_batch(table, spark.createDataFrame([], SCHEMA), 1)
    put(spark, table, 2, ("f", 0, 1, "more", True))
    assert [(r[1], r[5]) for r in shown(table)] == [(1, 3), (2, 3)]


def test_files_as_a_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for n, (a, b) in enumerate([(0, 5), (5, 10)]):
        (inbox / f"app.log@{n:04d}.log").write_bytes("".join(t + "\r\n" for t in GOLDEN[a:b]).encode())
        tail.stream_records(tail.read_log_stream(spark, str(inbox)), out, availableNow=True).awaitTermination()
    rows = shown(tail.LogTable(spark, out))
    assert {r[0].rsplit("/", 1)[1] for r in rows} == {"app.log"}
    assert [r[2] for r in rows] == GOLDEN and [(r[3], r[4], r[5]) for r in rows] == group(GOLDEN)


def follow(spark, folder, out):
    appended.follow(spark, str(folder), out, availableNow=True).awaitTermination()
    return [(r[0].rsplit("/", 1)[1], *r[1:]) for r in shown(tail.LogTable(spark, out))]


def test_appended_bytes(spark, tmp_path):
    """Bytes come in any portions: within lines, within characters, between the bytes of a line end."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    (inbox / "sub").mkdir(parents=True)
    whole = "\ufeff" + "\r\n".join(GOLDEN) + "\r\n"
    data, cuts = whole.encode(), [0, 1, 40, 41, 153, 154, 155, 200]
    cuts.append(data.index("диск".encode()) + 3)
    cuts.append(data.index(b"\r\n", 300) + 1)
    cuts = sorted({*cuts, len(data)})
    for a, b in zip(cuts, cuts[1:]):
        with open(inbox / "sub" / "f.log", "ab") as handle:
            handle.write(data[a:b])
        (inbox / "ignored.txt").write_text("x\n")
        rows = follow(spark, inbox, out)
        if b < 3:  # less than a byte order mark
            assert rows == []
            continue
        text = data[:b].decode("utf-8", "ignore")
        assert len(rows) >= text.count("\n") and rows[-1][6] == (not text.endswith("\n"))
    assert [r[2] for r in rows] == GOLDEN and [(r[3], r[4], r[5]) for r in rows] == group(GOLDEN)
    assert [r[1] for r in rows] == list(range(1, 11)) and not any(r[6] for r in rows)


def test_appended_file_that_is_replaced(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "cut.log").write_text("2026-07-10 12:00:00 INFO a\nmore\nhalf")
    (inbox / "same.log").write_text("2026-07-10 12:00:00 INFO b\n")
    assert len(follow(spark, inbox, out)) == 4
    (inbox / "cut.log").write_text("short\n")
    assert [(r[0], r[2]) for r in follow(spark, inbox, out)] == [("cut.log", "short"), ("same.log", "2026-07-10 12:00:00 INFO b")]
    (inbox / "same.log").write_text("2026-07-10 12:00:00 INFO c\nlonger than before\n")  # other bytes before the old end
    (inbox / "new.log").write_text("n")
    rows = follow(spark, inbox, out)
    assert [(r[0], r[1], r[2], r[6]) for r in rows] == [
        ("cut.log", 1, "short", False), ("new.log", 1, "n", True), ("same.log", 1, "2026-07-10 12:00:00 INFO c", False), ("same.log", 2, "longer than before", False)]
    assert follow(spark, inbox, out) == rows


def test_ranges_of_bytes():
    draw = random.Random(4)

    class Bytes:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    for _ in range(300):
        data = b"".join(b"x" * draw.choice([0, 0, 1, 5, 30]) + b"\n" for _ in range(draw.randrange(12))) + b"tail" * draw.randrange(2)
        for first in (0, data.find(b"\n") + 1):
            for width in (1, 3, 8, 100):
                found = [
                    row for at in range(first, len(data), width)
                    for row in range_lines(Bytes(data + b"later\n"), first, at, min(at + width, len(data)), len(data), draw.choice([1, 2, 7, 1000]))
                ]
                pieces = data[first:].split(b"\n")
                assert b"\n".join(p for _, p, _ in found) == b"\n".join(pieces[:-1] if not pieces[-1] else pieces)
                assert all(data[at : at + len(p)] == p for at, p, _ in found)
                assert [e for _, _, e in found] == [True] * (len(pieces) - 1) + [False] * bool(pieces[-1])


@pytest.fixture
def stored(spark, tmp_path, lines_of):
    log = assign_records(classify(lines_of(f=GOLDEN, g=GOLDEN[2:])))
    path = str(tmp_path / "stored")
    log.write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(log.schema).parquet(path)


def test_live_view(spark, tmp_path, stored):
    batch, stream = stored
    spec = FilterSpec(levels=["FATAL", "DEBUG"], rules=[Rule("boot"), Rule("store", connector="or")])
    view = live.live_view(stream, spec, [Rule("disk", color="red")])
    view.select("file_path", "line_no", "marker").writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect()))
    expected = live.live_view(batch, spec, [Rule("disk", color="red")]).select("file_path", "line_no", "marker")
    assert got == sorted(map(tuple, expected.collect())) and len(got) == 5


def test_live_timeline(spark, tmp_path, stored):
    _, stream = stored
    heads = stream.where("is_primary").withColumn("ts", F.timestamp_millis("ts_ms"))
    live.write_updates(live.stream_timeline(heads, "1 second"), str(tmp_path / "t"), ["window_start"], availableNow=True).awaitTermination()
    rows = live.latest_updates(spark, str(tmp_path / "t"), ["window_start"]).orderBy("window_start").collect()
    assert [(r["total"], r["warn"], r["error"]) for r in rows] == [(3, 0, 0), (2, 2, 0), (2, 0, 2)]


def test_late_records_count(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, level int"
    for times in (["2026-07-10 09:00:00", "2026-07-10 15:00:00"], ["2026-07-10 16:00:00"], ["2026-07-10 09:00:30", "2026-07-09 01:00:00"]):
        rows = spark.createDataFrame([(t, 5) for t in times], "t string, level int")
        rows.select(F.col("t").cast("timestamp").alias("ts"), "level").write.mode("append").parquet(inbox)
        heads = spark.readStream.schema(schema).parquet(inbox)
        live.write_updates(live.stream_timeline(heads), out, ["window_start"], availableNow=True).awaitTermination()
    found = live.latest_updates(spark, out, ["window_start"]).orderBy("window_start").collect()
    assert [r["total"] for r in found] == [1, 2, 1, 1] == [r["error"] for r in found]


def test_live_statistics(spark, tmp_path, stored):
    _, stream = stored
    folder = str(tmp_path / "s")

    def append(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = live.stream_stats(
        live.stream_merge([stream]), folder, lambda: spark.read.parquet(f"{folder}/rows/batch=*"), append,
        lambda t: t.agg(F.count(F.lit(1)).alias("lines")), availableNow=True)
    query.awaitTermination()
    assert live.latest_report(spark, folder).first()["lines"] == 18
