import os

import pytest
from pyspark.sql import functions as F
from test_detect import GOLDEN

from lumberline.functions.detect import classify
from lumberline.functions.rules import Rule
from lumberline.operators.extract import structured_log
from lumberline.operators.filters import FilterSpec, apply_filters, filter_time
from lumberline.operators.records import assign_records, number_lines
from lumberline.plans.importers import PRESETS
from lumberline.session import pinned
from lumberline.sources import files, manifest, sinks
from lumberline.sources.storage import Storage
from lumberline.sources.synth import synth_lines, write_synth_log

SHOWN = ["line_no", "text", "logical_id", "level", "provisional"]


def numbered(frame, *columns):
    return [tuple(r) for r in frame.orderBy("file_path", "line_no").select(*columns).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_golden_file(spark, tmp_path, end, closed, mark):
    text = end.join(GOLDEN) + (end if closed else "")
    (tmp_path / "g.log").write_bytes(mark + text.encode())
    rows = numbered(files.read_log(spark, str(tmp_path)), *SHOWN)
    assert [r[1] for r in rows] == GOLDEN
    assert [r[2] for r in rows] == [0, 1, 1, 2, 2, 2, 3, 4, 4, 4]
    assert [r[4] for r in rows] == [False] * 9 + [not closed]


def test_bare_carriage_return_is_content(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rtwo\r\r\n\nlast")
    assert [r[0] for r in numbered(files.read_log(spark, str(tmp_path)), "text")] == ["one\rtwo\r", "", "last"]


def test_splits_do_not_matter(spark, tmp_path):
    texts = [f"2026-07-10 09:{i % 60:02d}:00,001 INFO record {i}" if i % 3 else "  more " + "x" * (i % 50) for i in range(3500)]
    (tmp_path / "big.log").write_text("\n".join(texts) + "\n")
    results = []
    for size in ("134217728", "16384", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            log = files.read_log(spark, str(tmp_path))
            assert size == "134217728" or log.select("block").distinct().count() > 4
            results.append(numbered(log, *SHOWN, "ts_ms"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] == results[2]
    assert [r[1] for r in results[0]] == texts
    assert [r[0] for r in results[0]] == list(range(1, 3501))


@pytest.mark.parametrize("encoding", ["UTF-16LE", "UTF-16BE", "UTF-32"])
def test_wide_encodings(spark, tmp_path, encoding):
    # Some characters hold the bytes of a newline, at even and at odd places.
    texts = ["2026-07-10 09:00:00,001 INFO a", "\u0a05\u0100 odd", "\u0400\u0a0a\u000b x", "", "end\u0a00\u0400"] * 40
    (tmp_path / "w.log").write_bytes(("\ufeff" + "\r\n".join(texts)).encode("UTF-32BE" if encoding == "UTF-32" else encoding))
    for size in ("134217728", "256"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = numbered(files.read_log(spark, str(tmp_path), encoding), "text")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r[0] for r in found] == texts


def test_each_file_has_its_encoding(spark, tmp_path):
    texts = ["2026-07-10 09:00:00,001 INFO \u0a05", "\u0a0a\u000b x \U0001f600", "", "end"]
    kinds = {"a": "utf-8", "b": "utf-8-sig", "c": "utf-16-le", "d": "utf-16-be", "e": "utf-32-le", "f": "utf-32-be"}
    for name, kind in kinds.items():
        for end in ("", "\n"):
            mark = "" if name in "ab" else "\ufeff"
            (tmp_path / f"{name}{len(end)}.log").write_bytes((mark + "\r\n".join(texts) + end).encode(kind))
    for size in ("134217728", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_log(spark, str(tmp_path), "auto").orderBy("file_path", "line_no").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found = {}
        for r in rows:
            found.setdefault(os.path.basename(r["file_path"]), []).append((r["text"], r["provisional"]))
        for name in kinds:
            assert found[f"{name}0.log"] == [(t, i == 3) for i, t in enumerate(texts)], name
            assert found[f"{name}1.log"] == [(t, False) for t in texts], name
    with pytest.raises(ValueError, match="latin"):
        files.read_lines(spark, str(tmp_path), "latin-1")


def test_stores_by_their_names(spark):
    storage = Storage((("fs.s3a.access.key", "a"), ("fs.s3a.secret.key", "b"), ("fs.s3a.endpoint", "store:9000"), ("fs.s3a.endpoint.region", "r")))
    for scheme in ("s3", "s3a", "s3n"):
        system, inside = storage.resolve(f"{scheme}://bucket/logs/app 1.log")
        assert (system.type_name, inside) == ("s3", "bucket/logs/app 1.log")
        assert storage.head(f"{scheme}://bucket/logs") + inside == f"{scheme}://bucket/logs/app 1.log"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.s3a.endpoint", "there")
    assert ("fs.s3a.endpoint", "there") in Storage.of(spark).settings
    spark.sparkContext._jsc.hadoopConfiguration().unset("fs.s3a.endpoint")


def test_discover(spark, tmp_path):
    for name in ("a.log", "b.TXT", "c.dat", "d", "sub/e.Log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    found = files.discover_logs(spark, str(tmp_path))
    assert sorted(os.path.basename(r["file_path"]) for r in found.collect()) == ["a.log", "b.TXT", "e.Log"]
    assert "content" not in found.columns
    only = files.discover_logs(spark, str(tmp_path), (".DAT",))
    assert [os.path.basename(r["file_path"]) for r in only.collect()] == ["c.dat"]


PART_1 = "2026-03-01 07:30:00,250 WARN [queue] очередь растёт\n2026-03-01 07:30:02,000 FATAL [store] disk al"
PART_2 = "most full: 3 % left\n    caused by: quota\n2026-03-01 07:31:00,000 DEBUG [queue] конец\n"


def test_refresh_equals_fresh_load(spark, tmp_path):
    def put(name, text, mode="w"):
        with open(tmp_path / name, mode, encoding="utf-8") as handle:
            handle.write(text)

    put("grown.log", PART_1)
    put("same.log", "2026-07-10 12:00:00 INFO b\n")
    put("gone.log", "c\n")
    put("cut.log", "dddd\neeee\n")
    put("rewritten.log", "1234\n5678\n")
    listing = files.discover_logs(spark, str(tmp_path))
    before = pinned(manifest.capture_manifest(listing))
    log = pinned(files.read_log(spark, str(tmp_path)))

    put("grown.log", PART_2, "a")
    put("cut.log", "d")
    put("rewritten.log", "1234\n5679\nmore\n")
    put("new.log", "new\nfile")
    (tmp_path / "gone.log").unlink()
    listing = files.discover_logs(spark, str(tmp_path))
    changes = pinned(manifest.diff_manifest(before, manifest.current_state(listing, before)))
    kinds = {os.path.basename(r["file_path"]): r["change"] for r in changes.collect()}
    assert kinds == {
        "grown.log": "appended", "same.log": "unchanged", "gone.log": "missing", "cut.log": "replaced",
        "rewritten.log": "replaced", "new.log": "new",
    }
    after = manifest.refresh(log, changes, manifest.read_changes(log, changes))
    fresh = files.read_log(spark, str(tmp_path))
    columns = ["file_path", *SHOWN]
    assert numbered(after, *columns) == numbered(fresh, *columns)
    assert log.where(F.col("file_path").endswith("grown.log")).count() == 2


def test_open_lines_failed_reads_and_known_files(spark, tmp_path):
    (tmp_path / "open.log").write_text("2026-07-10 12:00:00 INFO a\nhalf")
    listing = files.discover_logs(spark, str(tmp_path))
    before = manifest.capture_manifest(listing)
    log = pinned(files.read_log(spark, str(tmp_path)))
    changes = manifest.diff_manifest(before, manifest.current_state(listing, before))
    assert [r["change"] for r in changes.collect()] == ["unchanged"]
    # A file whose manifest row was lost is new, but its rows are there already.
    changes = pinned(manifest.diff_manifest(before.where("false"), manifest.current_state(listing, before.where("false"))))
    assert [r["change"] for r in changes.collect()] == ["new"]
    assert manifest.refresh(log, changes, manifest.read_changes(log, changes)).count() == 2
    gone = spark.createDataFrame([(f"file:{tmp_path}/none.log", 5)], "file_path string, file_size bigint")
    with pytest.raises(Exception):
        manifest.capture_manifest(gone)


def test_ranges_read_every_line_once(spark, tmp_path):
    texts = ["x" * (i % 17) for i in range(60)]
    (tmp_path / "r.log").write_text("\n".join(texts))
    size = (tmp_path / "r.log").stat().st_size
    row = spark.createDataFrame([(f"file:{tmp_path}/r.log", 0, size)], "file_path string, first bigint, size bigint")
    for width in (1, 7, 100, 1 << 20):
        lines = manifest.read_ranges(row, width).orderBy("seq").collect()
        assert [r["text"] for r in lines] == texts


def test_save_view(spark, tmp_path, lines_of):
    (tmp_path / "in.log").write_text("\n".join(reversed(GOLDEN)) + "\n")
    log = files.read_log(spark, str(tmp_path / "in.log"))
    target = str(tmp_path / "out")
    sinks.save_view(log, target)
    parts = sorted(p for p in os.listdir(target) if p.startswith("part-"))
    saved = "".join((tmp_path / "out" / p).read_text() for p in parts).split("\n")[:-1]
    expected = log.orderBy(F.col("ts_ms").asc_nulls_last(), "file_path", "logical_id", "line_no").collect()
    assert saved == [r["text"] for r in expected]
    with pytest.raises(Exception):
        sinks.save_view(log, target)
    for refused in (str(tmp_path / "in.log"), f"file:{tmp_path}"):
        with pytest.raises(ValueError):
            sinks.save_view(log, refused)


def test_synthetic_log_is_deterministic(spark, tmp_path):
    one = synth_lines(spark, 500, seed=3).orderBy("seq").collect()
    two = synth_lines(spark, 500, seed=3).repartition(7).orderBy("seq").collect()
    assert one == two and one != synth_lines(spark, 500, seed=4).orderBy("seq").collect()
    log = assign_records(classify(synth_lines(spark, 500, seed=3)))
    assert log.agg(F.max("logical_id")).first()[0] == 499
    shares = {r["level"]: r["n"] for r in log.where("is_primary").groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert shares[3] > 200 and shares[3] > shares[2] > shares[5]
    write_synth_log(synth_lines(spark, 50), str(tmp_path / "crlf"), "\r\n")
    assert files.read_lines(spark, str(tmp_path / "crlf")).count() == synth_lines(spark, 50).count()


def test_number_lines(lines_of):
    rows = number_lines(lines_of(3, a=list("abcdefgh"), b=list("xy"))).orderBy("file_path", "seq").collect()
    assert [r["line_no"] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, 1, 2]


def test_stored_lines(spark, tmp_path, lines_of):
    log = assign_records(classify(lines_of(f=GOLDEN)))
    stored = files.store_lines(log, str(tmp_path / "t"))
    assert stored.count() == len(GOLDEN)
    day = stored.where("log_date = date'2031-01-05'")
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().toString()
    assert day.count() == 6


def test_ingest_equals_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.log").write_text("\n".join(GOLDEN))
    table = files.ingest_log(spark, str(tmp_path / "in"), str(tmp_path / "t"))
    direct = files.read_log(spark, str(tmp_path / "in"))
    assert numbered(table, *SHOWN) == numbered(direct, *SHOWN)
    schema = PRESETS["bracketed"]
    (tmp_path / "in" / "g.log").write_text("[2026-07-10 09:00:00] [INFO] a\n[2026-07-10 09:00:01] b\n  c\n")
    table = files.ingest_log(spark, str(tmp_path / "in"), str(tmp_path / "t2"), schema=schema)
    rows = table.orderBy("line_no").collect()
    assert [(r["logical_id"], r["level"]) for r in rows] == [(0, 3), (1, 0), (1, 0)]
    assert [r["fields"] and r["fields"]["Message"] for r in rows] == ["a", "b", None]
    same = structured_log(files.read_lines(spark, str(tmp_path / "in")), schema).orderBy("line_no").collect()
    assert [r["logical_id"] for r in same] == [0, 1, 1] and [r["is_plain"] for r in same] == [False] * 3


def test_filters_reach_the_scan(spark, tmp_path, lines_of):
    stored = files.store_lines(assign_records(classify(lines_of(f=GOLDEN))), str(tmp_path / "t"), by_date=False)
    spec = FilterSpec(levels=["ERROR"], start="2026-07-10 00:00:00", rules=[Rule("x")])
    plan = apply_filters(stored, spec).select("line_no")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(level,5)" in plan or "In(level" in plan
    assert "GreaterThanOrEqual(ts_ms" in plan and "own_ms" not in plan.split("ReadSchema")[1]


def test_time_filters_prune_days(spark, tmp_path, lines_of):
    stored = files.store_lines(assign_records(classify(lines_of(f=GOLDEN))), str(tmp_path / "t"))
    day = "2031-01-05 00:00:00"
    for bounds in ({"start": day}, {"end": day}, {"start": day, "end": "2031-01-05 23:59:59"}, {"start": 0, "end": 1}, {"start": -(10**17)}):
        kept = filter_time(stored, **bounds)
        if bounds.get("start") != -(10**17):
            assert "log_date" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        plain = filter_time(stored.withColumnRenamed("log_date", "d"), **bounds)
        assert sorted(r["line_no"] for r in kept.collect()) == sorted(r["line_no"] for r in plain.collect())


def test_written_rows_are_encoded_behind_their_order(spark, tmp_path, monkeypatch):
    """What is moved and sorted are the texts, not the bytes made of them."""
    from pyspark.sql import functions as F

    from lumberline.catalog import base

    rows = spark.createDataFrame([("/a.txt", i, f"row {i}\n") for i in reversed(range(50))] + [("/b.txt", 0, "one")], "file_path string, seq int, word string")
    base.write_files(rows, str(tmp_path / "out"), F.encode(F.col("word"), "UTF-16LE"))
    assert (tmp_path / "out" / "a.txt").read_bytes().decode("utf-16-le") == "".join(f"row {i}\n" for i in range(50))
    assert (tmp_path / "out" / "b.txt").read_bytes().decode("utf-16-le") == "one"
