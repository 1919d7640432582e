"""Operators over whole tables, against brute force."""

import base64
import hashlib
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumberline.llm import components, dartminhash, decontaminate, langid, sharding, toxicity, warc
from lumberline.llm.common import Words, is_training_row

SYLLABLES = "ka lo mi ne ru sa to vi".split()


def words(draw, n):
    return ["".join(draw.choice(SYLLABLES) for _ in range(3)) for _ in range(n)]


# ---- sharding ----------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(docs):
    draw = random.Random(1)
    rows = [(i, "x" * draw.randrange(400)) for i in range(2500)] + [(5000 + i, "copy " * 30) for i in range(1200)] + [(None, None), (7, ""), (7, "")]
    found = sharding.shard(docs(rows), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in rs) for rs in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) < 0.06 * sum(sizes) / 8
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    small = Counter()
    for r in found:
        if r.size < 150:
            small[r.text_crc32] |= 1 << r.shard
    assert all(bin(v).count("1") == 1 for v in small.values())
    assert sharding.shard(docs([]), 8).count() == 0


# ---- decontamination ---------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    have, hit, found = plain_words(text), set(), set()
    for item, body in items:
        want = plain_words(body)
        n = min(10, len(want))
        for p in range(len(want) - n + 1) if n else ():
            for q in range(len(have) - n + 1):
                if have[q : q + n] == want[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(str(item))
    return len(have), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, docs, block_bytes):
    draw = random.Random(4)
    items = [(i, " ".join(words(draw, draw.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (None, "kalomi"), (52, "ÉTÉ, Été! a1")]
    rows = [(0, None), (1, ""), (2, "été Été a1 ÉTÉ"), (3, "?!")]
    for i in range(120):
        body = words(draw, draw.randrange(60))
        if i % 3 == 0:
            source = plain_words(draw.choice(items)[1]) or ["x"]
            a = draw.randrange(len(source))
            body[5:5] = source[a : a + draw.randrange(1, 14)]
        rows.append((10 + i, draw.choice([" ", ", ", "\n"]).join(w.upper() if draw.random() < 0.1 else w for w in body)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(docs(rows), bench, block_bytes=block_bytes).collect()
    known = [(i, t) for i, t in items if i is not None and t is not None]
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found} == {i: plain_hits(t, known) for i, t in rows}


def test_no_items_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(docs([(1, "a b")]), none).collect()] == [(2, 0)]
    assert decontaminate.contamination(docs([]), none).count() == 0


# ---- near duplicates ---------------------------------------------------------------------------

def multiset(text):
    w = plain_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(rows):
    sets = {i: multiset(t) for i, t in rows}
    label = {i: i for i, _ in rows}
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    texts = dict(rows)
    for a in label:
        for b in label:
            if a < b and texts[a] is not None and texts[b] is not None:
                either = sum((sets[a] | sets[b]).values())
                if texts[a] == texts[b] or either and sum((sets[a] & sets[b]).values()) >= 0.8 * either:
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: root(i) for i in label}


def test_near_duplicates_equal_brute_force(docs):
    draw = random.Random(9)
    rows = [(0, None), (1, ""), (2, ""), (3, None), (4, "one two"), (5, "One, two!"), (6, "one three")]
    for family in range(6):
        base = words(draw, draw.choice([12, 80, 150]))
        for _ in range(14):
            body = list(base)
            for _ in range(draw.randrange(7)):
                body[draw.randrange(len(body))] = draw.choice(words(draw, 1))
            rows.append((len(rows), " ".join(body)))
    rows += [(len(rows) + i, " ".join(words(draw, 50))) for i in range(20)]
    found = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs(rows)).collect()}
    assert found == plain_classes(rows)


def test_families_around_the_threshold_equal_brute_force(docs):
    """Texts with repeated passages, of which most pairs are 0.6 to 0.9 alike and share buckets."""
    draw = random.Random(21)
    rows = []
    for _ in range(2):
        base = words(draw, 90) + ["again and again the same old song"] * 4 + words(draw, 40)
        for _ in range(45):
            body = " ".join(base).split()
            for _ in range(draw.randrange(2, 7)):
                body[draw.randrange(len(body))] = draw.choice(["left", "right", *words(draw, 1)])
            rows.append((len(rows), " ".join(body + body[:7] * draw.randrange(2))))
    found = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs(rows)).collect()}
    assert found == plain_classes(rows)


def test_parities_never_exceed_the_difference():
    draw = random.Random(5)
    base = words(draw, 300)
    bodies = [" ".join(w if draw.random() > 0.1 else "x" for w in base) for _ in range(12)] + ["", "one two", "a b c d e " * 30]
    data, parity = dartminhash._shingle_sets(pa.array(bodies))
    for i, a in enumerate(bodies):
        for j, b in enumerate(bodies):
            apart = sum(((multiset(a) | multiset(b)) - (multiset(a) & multiset(b))).values())
            bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(parity[i].as_py(), parity[j].as_py()))
            assert bits <= apart and (bits >= 0.6 * apart or max(i, j) >= 12)


def test_signatures_estimate_weighted_jaccard():
    draw = random.Random(3)
    a = words(draw, 400)
    b = a[:330] + words(draw, 70)
    texts = Words(pa.array([" ".join(a), " ".join(b), " ".join(a)]))
    grams, rows = dartminhash.shingles(texts)
    s = dartminhash.signatures(grams, rows, 3, 2000)
    x, y = multiset(" ".join(a)), multiset(" ".join(b))
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs(float((s[0] == s[1]).mean()) - true) < 0.05 and (s[0] == s[2]).all() and np.isfinite(s).all()


def test_one_row_of_equal_rows_is_kept(docs):
    kept = dartminhash.near_duplicates(docs([(1, "a b c d e f")] * 3 + [(None, "q w e r t y")])).collect()
    assert sum(r.kept for r in kept if r.doc_id == 1) == 1 and sum(r.kept for r in kept) == 2
    assert dartminhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("small", [200_000, 0])
def test_components_of_chains(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    links = [(i, i + 1) for i in range(20)] + [(40, 30), (31, 40), (50, 51), (51, 50), (60, 60)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 30, 50: 50, 51: 50}


# ---- archive -----------------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1\r\nX: y", "same"), (2, None, "other é"), (4, "u4", None), (5, "u5", ""), (5, "u5", ""), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, header string")
    warc.write_archive(pages, str(tmp_path / "a"))
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in found) == Counter((i, t or "") for i, _, t in rows)
    for r in found:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() and r.payload_bytes == len(r.payload)
        assert "\r\nX:" not in r.header
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found) == [
        (0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (5, "revisit", 4)]
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    whole = {r.page_id: bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, str(tmp_path / "a"))).collect()}
    assert whole[2].endswith("\r\n\r\nother é\r\n\r\n".encode()) and b"Content-Length: 0\r\n" in whole[3]
    ids = [h.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for h in (bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, str(tmp_path / "a"))).collect())]
    assert len(set(ids)) == len(rows) and all(b"\r\nWARC-Date: 2" in w for w in whole.values())
    assert ids[0].startswith(b"<urn:uuid:") and b"WARC-Refers-To: " + [w for w in whole.values() if b"Page-ID: 1\r" in w][0].split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] in whole[3]
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_archive_of_odd_ids_and_long_payloads(spark, tmp_path):
    names = ["a>b", "x\r\nWARC-Type: fake", "", "é %41+ ", None, "z"]
    rows = [(i, "u", "one") for i in names] + [(i, "u", f"own {i}") for i in names] + [("long", "u", "page " * 1_000_000), ("later", "u", "page " * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"), date="2024-01-01T00:00:00Z")
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in found) == Counter((i, t) for i, _, t in rows)
    assert {r.page_id: r.refers_to for r in found if bytes(r.payload) == b"one"} == {i: None if i == "" else "" for i in names}
    assert [r.refers_to for r in found if r.page_id == "long"] == ["later"] and all(r.header.count("WARC-Type: ") == 1 for r in found)
    small = tmp_path / "small"
    warc.write_archive(pages, str(small), least_revisit=4)
    assert Counter(r.record_type for r in warc.read_archive(spark, str(small)).collect()) == {"response": 13, "revisit": 1}


def test_archive_notices_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id bigint, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    records = spark.read.parquet(str(tmp_path / "a" / "records"))
    swapped = records.withColumn("header", F.regexp_replace("header", "sha1:.", "sha1:7"))
    swapped.write.parquet(str(tmp_path / "b" / "records"))
    for part in ("payloads", "layout"):
        shutil.copytree(tmp_path / "a" / part, tmp_path / "b" / part)
    with pytest.raises(Exception, match="differ"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


# ---- models ------------------------------------------------------------------------------------

def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_on_held_out_rows(spark):
    draw = random.Random(6)
    vocabulary = {k: ["".join(draw.choice(a) for _ in range(5)) for _ in range(60)] for k, a in {"aa": "abcde", "bb": "cdefg", "cc": "xyzéü"}.items()}
    rows = [(i, " ".join(draw.choice(vocabulary[k]) for _ in range(40)), k) for i in range(400) for k in [draw.choice("aa bb cc".split())]]
    rows += [(1000, None, None), (1001, "12 34 !?", "aa"), (1002, "", "bb"), (1003, " ".join(vocabulary["aa"][:30] + vocabulary["cc"][:20]), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    right = [found[i].lang_pred == k for i, _, k in rows if i < 1000 and held_out(i)]
    assert sum(right) >= 0.95 * len(right)
    assert {found[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert found[1003].lang_pred == "aa" and 0.4 < found[1003].score < 0.8
    empty = df.limit(0)
    assert {r.lang_pred for r in langid.identify(df, langid.train(empty)).collect()} == {"und"}
    assert {r.doc_id: r.ok for r in df.select("doc_id", is_training_row(df.doc_id).alias("ok")).collect()} == {r[0]: not held_out(r[0]) for r in rows}


def toxic_rows():
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        body, bad = words(draw, 30), i % 7 == 0
        if bad:
            for stem in draw.sample(["zorgul", "blafix", "quermp"], 2):
                body[draw.randrange(30)] = stem + draw.choice(["", "ka", "tolo"])
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1002, "Zorgulette BLAFIXEN")]
    index = toxicity.train(docs(rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int"))
    found = {r.doc_id: r for r in toxicity.toxicity(docs(rows), index).collect()}
    wrong = [i for i, _, bad in labels if held_out(i) and (found[i].score >= toxicity.THRESHOLD) != bool(bad)]
    assert not wrong and found[1002].score >= 0.3 and found[1000].score == found[1001].score < 0.3
    assert all(0 <= r.score <= 1 for r in found.values())


def test_neighbours_equal_brute_force(spark, docs):
    rows, labels = toxic_rows()
    index = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    examples = index.vectors(pa.array([dict(rows)[i] for i in index.ids.tolist()])).dense(len(index.features))
    queries = index.vectors(pa.array([t for _, t in rows]))
    some = np.flatnonzero(np.diff(queries.ends))
    _, near = index.nearest(queries.take(some))
    brute = np.sort(queries.take(some).dense(len(index.features)) @ examples.T, axis=1)[:, ::-1][:, : toxicity.NEIGHBOURS]
    assert len(some) > 50 and np.abs(near - brute).max() < 1e-4


def test_toxicity_without_labels(spark, docs):
    index = toxicity.train(docs([(1, "a")]), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.score for r in toxicity.toxicity(docs([(1, "a")]), index).collect()] == [0.0]


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, tmp_path):
    rows, labels = toxic_rows()
    draw = random.Random(12)
    long = words(draw, 60)
    passage = " ".join(words(draw, 20))
    rows += [(2000, " ".join(long)), (2001, " ".join([*long[:-1], "other"])), (2002, f"before {passage} after"), (2003, None), (2003, None), (2004, "twice the same"), (2004, "twice the same")]
    rows += [(3000 + i, f"menu of the site\npage {i} {' '.join(words(draw, 12))}") for i in range(80)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, str(tmp_path))
        if name != "byte_bpe":
            assert after.columns == frame.columns and after.schema == frame.schema
        after.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        ids = Counter(r.doc_id for r in frame.select("doc_id").collect())
        if name == "toxicity":
            bad = {i for i, _, toxic in labels if toxic}
            assert not bad & set(ids) and sum(ids.values()) == len(rows) - len(bad)
        elif name == "line_dedup":
            assert frame.where("text like '%menu of the site%'").count() == 0
            assert frame.where("n_chars <> length(text)").count() == 0
        elif name == "near_duplicates":
            assert ids[2000] == 1 and ids[2001] == 0 and ids[2003] == 2 and ids[2004] == 1
        elif name == "decontamination":
            assert ids[2002] == 0 and ids[2000] == 1
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
