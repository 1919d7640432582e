"""Operators on one text at a time, against public libraries and plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumberline.llm import bpe, lines, planes, quality
from lumberline.llm.catalog import BPE_RANKS, PLANES_TOKENIZER

HARD = [
    (1, None), (2, ""), (3, " "), (4, "don't we'll I'VE 's't'restop  \n\n x"), (5, "été 日本 ١٢ ½ 🙂́  　end "), (6, "a" * 3000 + " " * 500 + "é" * 900),
    (7, "same text"), (7, "same text"), (None, "no id"), (8, "x <|endoftext|> y"), (9, "'" * 5 + "'s" + "\t'll\r\n"),
]


def shuffled_texts(n):
    draw = random.Random(5)
    return ["".join(draw.choice(" \t\n  'strevldmSTabcé1²٣!?#日本🙂́x  ''\r") for _ in range(draw.randrange(40))) for _ in range(n)]


def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs):
    rows = HARD + [(100 + i, t) for i, t in enumerate(shuffled_texts(2000))]
    encoder = reference_encoder()
    want = Counter()
    for i, t in rows:
        ids = encoder.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs(rows), BPE_RANKS).collect())) == want


def test_bpe_offsets_and_decoding(docs):
    encoded = bpe.encode(docs(HARD), BPE_RANKS, carry=("doc_id", "text"))
    for row in bpe.decode(encoded, BPE_RANKS, carry=("text", "ends")).collect():
        assert row.decoded.decode() == (row.text or "") and (row.ends[-1] if row.ends else 0) == len((row.text or "").encode())


def test_automaton_composes_like_single_steps():
    classes = np.random.default_rng(1).integers(0, 16, 5000).astype(np.uint8)
    state, flags = 0, []
    for kind in classes.tolist():
        state, begins = bpe._rule(state, kind)
        flags.append(begins)
    assert bpe.piece_starts(classes).tolist() == flags


def test_planes_round_trip(spark, docs, tmp_path):
    rows = HARD + [(100 + i, t) for i, t in enumerate(shuffled_texts(300))]
    tokenizer = Tokenizer.from_file(PLANES_TOKENIZER)
    folder = f"file://{tmp_path}/planes"
    df = docs(rows)
    manifest = planes.write_planes(df, folder, PLANES_TOKENIZER)
    found = planes.read_planes(spark, folder, manifest, df.schema["doc_id"].dataType).orderBy("start").collect()
    at = 0
    texts = Counter()
    for row in found:
        assert row.start == at and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        texts[(row.doc_id, tuple(row.ids))] += 1
        at += row.n_tokens
    assert texts == Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    ids = [row.doc_id for row in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert "planes" in planes.describe(folder, manifest.first().file)


def test_planes_of_chunks_and_damage(tmp_path):
    ids = np.arange(planes.CHUNK * 2 + 5, dtype=np.uint32)
    with open(tmp_path / "f", "wb") as out:
        writer = planes.PlaneWriter(out)
        writer.add(ids)
        writer.close(pa.table({"doc_id": [1, 2], "n": [3, len(ids) - 3]}))
    got = [np.asarray(c[4].flatten()) for c in planes._read_file(str(tmp_path), "f", 0, True)]
    assert np.concatenate(got).tolist() == ids.tolist()
    data = bytearray((tmp_path / "f").read_bytes())
    data[20] ^= 255
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(planes._read_file(str(tmp_path), "f", 0, True))


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    hit = {p for i, w in enumerate(windows) if many[w] > 1 for p in range(i, i + 8)}
    kept = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(kept) - len(set(kept)), len(hit)


def test_quality_equals_plain_counts(docs):
    draw = random.Random(2)
    base = " ".join(draw.choice(["the", "of", "alpha", "bêta", "gamma#"]) for _ in range(60))
    texts = [t for _, t in HARD] + [base, base + "\n" + base, "a b c d e f g h " * 9, "\x0b\x0c x\x1cy", "one line\none line\n \nother", "# * $ % & | < >"]
    texts += [" ".join(draw.choice("ab") for _ in range(n)) for n in range(0, 60, 3)]
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measures(docs(rows)).collect()}
    assert found == {i: plain_measures(t) for i, t in rows}


def test_quality_verdicts_and_plan(docs):
    good = "the cat and the dog went to see that it was of use for all those who live in this very old town by the sea"
    judged = quality.quality(docs([(1, good), (2, "short one"), (3, None), (4, "### $$$ " * 20 + good), (5, "the quick brown fox jumps over it and " * 10)]))
    assert {r.doc_id: r.kept for r in judged.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality.quality(docs([])).count() == 0


def test_lines_by_site(spark, docs):
    rows = [(i, f"menu home\nstory {i}\n\nfooter") for i in range(8)] + [(8, None), (9, ""), (10, "menu home")]
    other = [(20 + i, f"menu home\nelse {i}") for i in range(3)]
    df = docs(rows, source="a").union(docs(other, source="b")).union(docs([(30, "menu home\nz")], source=None))
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(df, ratio=0.5).collect()}
    assert found[0] == ("story 0\n", 4, 2) and found[8] == (None, 0, 0) and found[9] == ("", 1, 0) and found[10] == ("", 1, 1)
    assert found[20] == ("menu home\nelse 0", 2, 0) and found[30] == ("menu home\nz", 2, 0)


def test_copies_of_a_page_are_one_page(docs):
    df = docs([(i, "copied line\nsecond line") for i in range(50)] + [(100 + i, f"own {i}") for i in range(5)])
    assert lines.boilerplate(df).count() == 0


def test_lines_with_many_hosts_joins_by_salt(docs, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    df = docs([(i, f"menu\nstory {i}") for i in range(20)])
    assert lines.drop_boilerplate(df).where(F.col("text").startswith("menu")).count() == 0
