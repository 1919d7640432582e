import random

import pytest
from model import detect_level, detect_ms, group
from pyspark.sql import functions as F

from lumberline.functions import detect
from lumberline.operators.records import assign_records

AT = "2031-01-05 04:05:06"

# One rule per group: text, expected time (None = none), expected level.
CORPUS = [
    # The first full form counts, wherever it stands, with a blank or a T.
    (f"job 7 began {AT}", f"{AT}.000", 0),
    ("<2031-01-05T04:05:06>", f"{AT}.000", 0),
    (f"{AT} not 2031-01-06 00:00:00", f"{AT}.000", 0),
    (f"77{AT}", f"{AT}.000", 0),
    # Digits behind a dot or a comma are a number of milliseconds; too large a number is no time.
    (f"{AT}.42", f"{AT}.042", 0),
    (f"{AT},042 debug", f"{AT}.042", 2),
    (f"{AT},999!", f"{AT}.999", 0),
    (f"{AT}.1000", None, 0),
    (f"{AT},98765432109876", None, 0),
    (f"{AT}.", f"{AT}.000", 0),
    (f"{AT};5", f"{AT}.000", 0),
    # Only the first one is looked at, also if there is no such time.
    (f"2031-00-05 04:05:06 or {AT}", None, 0),
    ("2031-04-31 00:00:00", None, 0),
    ("2028-02-29 12:00:00", "2028-02-29 12:00:00.000", 0),
    ("2031-02-29 12:00:00", None, 0),
    ("2031-01-05 24:00:00", None, 0),
    ("2031-01-05 04:60:00", None, 0),
    ("2031-01-05 04:05:61", None, 0),
    ("0000-05-05 05:05:05", None, 0),
    # Other forms stand at the beginning, the day first where both ways are dates, and have no milliseconds.
    ("05/01/2031 04:05:06 Debug", f"{AT}.000", 2),
    ("01/25/2031 04:05:06", "2031-01-25 04:05:06.000", 0),
    ("25.01.2031 04:05:06", "2031-01-25 04:05:06.000", 0),
    ("01.25.2031 04:05:06", None, 0),
    ("05-01-2031 04:05:06", None, 0),
    ("31/31/2031 04:05:06", None, 0),
    (">05/01/2031 04:05:06", None, 0),
    ("05/01/2031 04:05:06.700 warn", f"{AT}.000", 4),
    ("05/01/2031 04:05:06 sent 2031-02-03 00:00:01", "2031-02-03 00:00:01.000", 0),
    # The first whole word of the seven, in any case; only ASCII letters, digits and _ make words longer.
    ("", None, 0),
    ("wArNiNg: low", None, 4),
    ("[fatal]", None, 6),
    ("x=INFO;y=FATAL", None, 3),
    ("debug-trace", None, 2),
    ("no errors, preINFO, 9WARN, ERROR_CODE, err0r", None, 0),
    ("errors, then an error", None, 5),
    ("ΩTRACEΩ", None, 1),
    ("CRITICAL NOTICE VERBOSE", None, 0),
    ("ﬁNFO ıNFO İNFO", None, 0),
]


def detected(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = detect.classify(rows).withColumn("shown", detect.ms_text(F.col("own_ms"), "."))
    return found.orderBy("id").collect()


def test_corpus(spark):
    for row, (text, time, level) in zip(detected(spark, [c[0] for c in CORPUS]), CORPUS):
        assert (row["shown"], row["own_level"]) == (time, level), text
        assert row["is_primary"] == (time is not None and level > 0)


def test_fuzz_against_model(spark):
    draw = random.Random(31)
    seeds = [f"{AT},120 ERROR x", "25/01/2031 04:05:06 fatal", "01.02.2031 23:00:00 Info", "2031-01-05T04:05:06.7 [warning]"]
    alphabet = sorted({*"".join(seeds), *" 0123456789:/.,-_T", "ß", "И", "ſ", "K", "ı"})
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(50))) for _ in range(3000)]
    for _ in range(5000):
        text = draw.choice(seeds)
        for _ in range(draw.choice([1, 1, 2])):
            at = draw.randrange(len(text) + 1)
            text = text[:at] + draw.choice([*alphabet, ""]) + text[at + draw.choice([0, 1]) :]
        texts.append(text)
    for row, text in zip(detected(spark, texts), texts):
        assert row["own_level"] == detect_level(text), text
        assert row["own_ms"] == detect_ms(text), text


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = detected(spark, ["2026-03-08 02:30:00,005 INFO in the hour that New York skips"])[0]
        assert row["shown"] == "2026-03-08 02:30:00.005"
        back = spark.range(1).select(detect.ntz_to_ms(detect.ms_to_ntz(F.lit(row["own_ms"]))).alias("ms")).first()["ms"]
        assert back == row["own_ms"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_level_names(spark):
    names = [" warning ", "Fatal", "none", "UNKNOWN", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in rows.select(detect.level_from_name(F.col("name"))).collect()] == [4, 6, 0, 0, 0]


# A heading, records of one and of several lines in every form of time, and lines that have half of what a record needs.
GOLDEN = [
    "=== night shift ===",
    f"{AT},120 DEBUG boot: reading settings",
    "",
    f"{AT},900 FATAL store: диск недоступен",
    "java.io.IOException: no space",
    "\tat store.Disk.write(Disk.java:77)",
    "2031-01-05T04:05:07.5 Warning queue: длинная очередь",
    "05/06/2031 00:00:01 error by hand",
    "later INFO without a time",
    "2031-01-05 04:05:09 a time without a level",
]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_records_do_not_depend_on_blocks(lines_of, block):
    found = assign_records(detect.classify(lines_of(block, golden=GOLDEN, other=GOLDEN[2:])))
    rows = found.orderBy("file_path", "line_no").collect()
    golden = [r for r in rows if r["file_path"] == "golden"]
    assert [(r["logical_id"], r["ts_ms"], r["level"]) for r in golden] == group(GOLDEN)
    assert [r["logical_id"] for r in golden] == [0, 1, 1, 2, 2, 2, 3, 4, 4, 4]
    assert [r["is_plain"] for r in golden] == [True] + [False] * 9
    assert [r["line_no"] for r in golden] == list(range(1, 11))
    other = [r for r in rows if r["file_path"] == "other"]
    assert [r["logical_id"] for r in other] == [0, 1, 1, 1, 2, 3, 3, 3]


def test_random_files_against_model(lines_of):
    draw = random.Random(5)
    texts = [draw.choice(GOLDEN) for _ in range(700)]
    for block in (7, 64):
        rows = assign_records(detect.classify(lines_of(block, f=texts))).orderBy("line_no").collect()
        assert [(r["logical_id"], r["ts_ms"], r["level"]) for r in rows] == group(texts)


def test_timestamps_without_levels_make_one_plain_record(lines_of):
    rows = assign_records(detect.classify(lines_of(f=["2026-07-10 09:00:00 a", "2026-07-10 09:00:01 b"]))).collect()
    assert {(r["logical_id"], r["ts_ms"], r["is_plain"]) for r in rows} == {(0, None, True)}
