"""Merkle manifest, importance resampling and packing, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumberline.llm import merkle, packing, resampling
from lumberline.llm.common import Words
from lumberline.llm.numbered import numbered

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- places ------------------------------------------------------------------------------------

def test_places_within_groups(spark):
    rows = [(None, 3), (None, 1), ("a", 2), ("a", 2), ("b", 5)] + [("hot", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    found = numbered(df, [F.col("v")], "test", within=["k"]).collect()
    by = defaultdict(list)
    for r in found:
        by[r.k].append((r.place, r.v))
    assert {k: sorted(v) for k, v in by.items()} == {None: [(0, 1), (1, 3)], "a": [(0, 2), (1, 2)], "b": [(0, 5)], "hot": [(i, i) for i in range(500)]}


# ---- merkle ------------------------------------------------------------------------------------

def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row):
    i, text, lang, source, n = row
    return sha("".join(map(told, (i, source, lang, n, text))))


def plain_tampered(row):
    i, text, *rest = row
    if i is None or text is None or zlib.crc32(str(i).encode()) % 5:
        return row
    return (i, re.sub("[A-Z]", lambda m: m[0].lower(), text), *rest)


def plain_tree(nodes):
    """The root, and the siblings of each node with its place among them."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for j in range(len(run)):
                for i in owners[at + j]:
                    paths[i].append((j, run[:j] + run[j + 1 :]))
            above.append(sha("".join(run)))
            held.append([i for o in owners[at : at + 16] for i in o])
        nodes, owners = above, held
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    root, over = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, outer in zip(sources, over, strict=True):
        for row, inner in zip(by[s], trees[s][1], strict=True):
            path_, node = inner + outer, plain_leaf(plain_tampered(row))
            for j, others in path_:
                node = sha("".join(others[:j]) + node + "".join(others[j:]))
            out.append((row[0], plain_leaf(row), trees[s][0], root, sha("".join(x for _, o in path_ for x in o)), node, node == root))
    return Counter(out)


def some_rows(draw, n, sources):
    return [(draw.randrange(3 * n), draw.choice(["Ab c", "xyz", "ÄÖ Z", "", None]), draw.choice(["en", None]), draw.choice(sources), draw.choice([1, None])) for _ in range(n)]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_plain_trees(spark, height):
    """Low superblocks make several rounds of the same rows; a hot source has most of them."""
    draw = random.Random(height)
    sources = [None, "", "a", "b", "B", "é"] + ([f"s{i:03}" for i in range(30)] if height == 1 else [])
    rows = some_rows(draw, 300, [*sources, *["hot"] * 3 * len(sources)])
    rows += [(None, "NULL id", "en", "a", 1), (None, "NULL id", "en", "a", 1), (5, "Same", None, "b", 2), (5, "Same", None, "b", 2), (7, "alone", "en", "single", 3)]
    found = merkle.manifest(spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, leaf string"), height=height)
    assert Counter(map(tuple, found.collect())) == plain_manifest(rows)


def test_manifest_of_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    lone = (10, "Lone ROW " + "x" * 3_000_000, "en", "s", None)
    (row,) = merkle.manifest(spark.createDataFrame([lone], DOCS)).collect()
    assert row.leaf == row.subroot == row.root == plain_leaf(lone) and row.proof_sha256 == sha("") and row.verified == (zlib.crc32(b"10") % 5 != 0)
    # Tampering that changes nothing is no tampering.
    calm = [(i, "all small", "en", "s", 1) for i in range(40)]
    assert all(r.verified for r in merkle.manifest(spark.createDataFrame(calm, DOCS)).collect())
    named = spark.createDataFrame([("b", "X", None, "s", 1), ("a", "Y", None, "s", 1), (None, "Z", None, "s", 1)], DOCS.replace("doc_id bigint", "doc_id string"))
    found = {r.doc_id: r for r in merkle.manifest(named).collect()}
    leaves = [plain_leaf((i, t, None, "s", 1)) for i, t in ((None, "Z"), ("a", "Y"), ("b", "X"))]
    assert found["a"].root == sha("".join(leaves)) and found["a"].proof_sha256 == sha(leaves[0] + leaves[2])


# ---- resampling --------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text, longest, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    s = Counter(b for _, t in rows for b in plain_buckets(t, longest, buckets))
    t = Counter(b for x in target for b in plain_buckets(x, longest, buckets))
    n_s, n_t = sum(s.values()), sum(t.values())
    scored = []
    for i, text in rows:
        got = plain_buckets(text, longest, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in got)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        scored.append((i, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, "" if r[0] is None else r[0], r[1]))
    drawn = able[: len(able) * percent // 100]
    ranked = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    return ranked + (Counter((*r[:4], None) for r in scored) - Counter((*r[:4], None) for r in drawn))


def prose(draw, n):
    return " ".join(draw.choice(["Alpha", "beta", "γάμμα", "delta9", "épsilon", "zeta", "z" * 90, "漢字"]) + draw.choice(["", ",", "\n"]) for _ in range(n))


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_resampling_equals_plain_python(spark, longest, buckets):
    draw = random.Random(longest)
    rows = [(i, prose(draw, draw.randrange(60))) for i in range(400)] + [(None, prose(draw, 50)), (None, None), (1000, ""), (1001, None)]
    rows += [(77, prose(draw, 30))] * 40  # equal rows, some of them drawn
    target = [prose(draw, 30) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, weight string, rank double")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, bench, longest=longest, buckets=buckets, percent=30)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == plain_resample(rows, target, longest, buckets, percent=30)


def test_resampling_of_edges(spark):
    shape = "doc_id bigint, text string"
    empty, none = spark.createDataFrame([], shape), spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    draw = random.Random(5)
    rows = [(i, prose(draw, 25)) for i in range(30)]
    assert Counter(map(tuple, resampling.resample(spark.createDataFrame(rows, shape), none).collect())) == plain_resample(rows, [])
    long = [(1, "word " * 600_000 + "w" * 400_000), (2, prose(draw, 40))]
    assert Counter(map(tuple, resampling.resample(spark.createDataFrame(long, shape), none, percent=50).collect())) == plain_resample(long, [], percent=50)


def test_resampling_of_text_ids_breaks_ties_bytewise(spark):
    rows = [("b" * k, "same words " * 12) for k in range(1, 30)] + [("", "same words " * 12), (None, "same words " * 12), ("é", "same words " * 12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = Counter(map(tuple, resampling.resample(docs, docs.select("text"), percent=40).collect()))
    assert found == plain_resample(rows, [t for _, t in rows], percent=40)


def test_first_rows_counts_down_to_the_last_key(spark):
    rows = [(3, 1, i) for i in range(20)] + [(2, 5, 100), (9, 9, 101), (3, 0, 102), (3, 2, 103)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    for most in (0, 1, 2, 3, 11, 22, 23, 24, 30):
        kept = df.where(resampling.first_rows(df, [F.col("a"), F.col("b"), F.col("c")], most)).collect()
        assert sorted(map(tuple, kept)) == sorted(rows)[:most]


def test_checksums_of_words():
    text = "one Two  漢字x " + "y" * 64 + " " + "z" * 65 + " a1"
    words = Words(pa.array([text, None, "tail"]))
    found = [resampling._crc_of(words, np.arange(len(words)), np.zeros(len(words), np.uint32))]
    assert found[0].tolist() == [zlib.crc32(w.encode()) for t in (text, "tail") for w in plain_words(t)]


# ---- packing -----------------------------------------------------------------------------------

TOKENIZER = path("word_bpe_49k.json")


def checked_pack(spark, rows, **options):
    """The pieces, after checking that they are the documents' ids in full sequences."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, start string, length double")
    found = packing.pack(docs, TOKENIZER, **options).collect()
    # Each document's pieces in turn: an Euler walk is not needed, since pieces of equal documents are interchangeable.
    want = defaultdict(list)
    for (i, _), own in zip(rows, ids, strict=True):
        want[i].append(own)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, own in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                part = own[0][at : at + r.length]
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own[0]), zlib.crc32(np.array(part, "<u4").tobytes()))
                at += r.length
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return found, padding / sum(map(len, ids))


def test_packing_is_whole_and_tight(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, int(draw.paretovariate(0.7) * 20) % 9000)) for i in range(300)]
    rows += [(None, "a null id"), (1000, None), (1001, ""), (1002, "<|endoftext|> it's ONE two x́ ́y é\u0085z Σας ﬁ " + "漢" * 500)]
    found, padding = checked_pack(spark, rows, group_bytes=200_000)
    assert padding < 0.005
    assert len({r.sequence_id >> 32 for r in found}) > 1


def test_packing_of_equal_rows_and_edges(spark):
    rows = [(5, "the same words again " * 30)] * 50
    found, padding = checked_pack(spark, rows)
    assert padding < 0.01 and Counter(r.doc_tokens for r in found if r.start == 0) == {found[0].doc_tokens: 50}
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), TOKENIZER).count() == 0
    checked_pack(spark, [(1, "word " * 700_000)])  # over 2 MB


def test_first_fit_equals_a_linear_search():
    draw = random.Random(9)
    for _ in range(30):
        lengths = sorted((draw.randrange(1, 101) for _ in range(draw.randrange(1, 200))), reverse=True)
        room, plain = [], []
        for i, n in enumerate(lengths):
            place = next((k for k, r in enumerate(room) if r >= n), len(room))
            if place == len(room):
                room.append(100)
                plain.append([])
            room[place] -= n
            plain[place].append(i)
        assert packing.first_fit(lengths, 100) == plain
        out = packing.filled([[(i, 0, lengths[i]) for i in parts] for parts in plain], 4, 100)
        cover = defaultdict(list)
        for parts in out:
            total = sum(n for _, _, n in parts)
            assert total > 96 or total & (total - 1) == 0
            for i, first, n in parts:
                cover[i].append((first, n))
        for i, n in enumerate(lengths):
            at = 0
            for first, k in sorted(cover[i]):
                assert first == at and k > 0
                at += k
            assert at == n
