"""One query per operator over its whole table, with the same query in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import bpe, dartminhash, decontaminate, langid, lines, merkle, packing, planes, quality, resampling, sharding, toxicity, warc
from lumberline.llm.common import is_training_row, table
from lumberline.session import checkpoint_dir

Run = Callable[[SparkSession, str], DataFrame]

PLANES_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT dw.rid, dw.p, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = array_to_string(dw.w[dw.p : dw.p + dw.n - 1], ' ')),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


@_query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op3_byte_planes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, folder = table(spark, sf_dir, "documents"), _folder(spark, "token-planes")
    manifest = planes.write_planes(documents, folder, PLANES_TOKENIZER)
    return planes.read_planes(spark, folder, manifest, documents.schema["doc_id"].dataType, with_ids=False)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(digest, {1 + 10 * i}, 10) AS UBIGINT) >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)"
    for i in range(4) for j in range(8)
)
OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS digest,
  row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k,
  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id FROM pages)
SELECT page_id, octet_length(body) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to FROM p"""


@_query("op4_warc", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@_query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_RANKS)


@_query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents.select("doc_id", "text"), langid.train(documents))
    return found.select("doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def _rule_sql(rule: quality.Rule) -> str:
    bounds = [f"{rule.measure} >= {rule.least}"] * (rule.least is not None) + [f"{rule.measure} <= {rule.most}"] * (rule.most is not None)
    return f"coalesce({' AND '.join(bounds)}, false)"


_SHARE = "CASE WHEN {1} > 0 THEN ({0}) / {1} END"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, p, array_to_string(words[p : p + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, p FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(list_distinct(list_filter(words, lambda x: x IN ({", ".join(f"'{s}'" for s in quality.STOP_WORDS)})))) AS n_stop_words,
  {_SHARE.format(r"len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]')))", "len(lines)")} AS bullet_line_share,
  {_SHARE.format(r"len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))", "len(lines)")} AS ellipsis_line_share,
  {_SHARE.format("len(lines) - len(list_distinct(lines))", "len(lines)")} AS dup_line_share FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, {_SHARE.format("word_chars", "n_words")} AS mean_word_chars, {_SHARE.format("n_symbols", "n_words")} AS symbols_per_word,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(_rule_sql, quality.THRESHOLDS))} AS kept FROM r"""


@_query("op9_quality", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op10_line_dedup", f"WITH {lines.drop_boilerplate_sql()} SELECT doc_id, source, text, n_lines, n_dropped FROM lined")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


#: The table of CRC-32 from its polynomial, for DuckDB, which has no such function.
_CRC_TABLE = "(SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def _crc_sql(hexed: str) -> str:
    """The checksum of the bytes that hexadecimal digits give, with the table as ``tab``."""
    given = f"list_transform(range(1, len({hexed}) // 2 + 1), lambda k: CAST(CAST('0x' || substr({hexed}, 2 * k - 1, 2) AS INTEGER) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {given}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


_TOLD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
#: Levels that the SQL climbs: 16 ** 7 rows of a source, 16 ** 5 sources.
_ROW_LEVELS, _SOURCE_LEVELS = 7, 5


def _merkle_sql() -> str:
    """Level by level: the nodes of each tree, their runs, and what stands beside each node.  A finished tree stays as it is."""
    head = [_TOLD.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = f"sha256({' || '.join([*head, _TOLD.format('text')])})"
    seen = f"sha256({' || '.join([*head, _TOLD.format('low')])})"
    crc = _crc_sql("hex(encode(CAST(doc_id AS VARCHAR)))")
    steps = [
        f"t AS {_CRC_TABLE}",
        f"a AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents, t)",
        f"b AS (SELECT row_number() OVER () AS rid, doc_id, source, {leaf} AS leaf, {seen} AS seen FROM a)",
        "s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM b))",
        "r AS (SELECT rid, doc_id, tree, leaf, seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source)",
        "n0 AS (SELECT tree, i, leaf AS h FROM r)",
    ]

    def level(k: int) -> None:
        steps.append(f"c{k} AS (SELECT tree, count(*) > 1 AS more FROM n{k} GROUP BY tree)")
        steps.append(f"n{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM n{k} JOIN c{k} USING (tree) GROUP BY tree, i // 16)")
        # Siblings to the left and to the right; a tree that is done has none and is not hashed again.
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
        steps.append(f"p{k} AS (SELECT tree, i, more, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS g FROM n{k} JOIN c{k} USING (tree))")

    for k in range(_ROW_LEVELS):
        level(k)
    top = _ROW_LEVELS
    steps.append(f"sub AS (SELECT tree, h AS subroot FROM n{top})")
    steps.append(f"n{top + 1} AS (SELECT 0 AS tree, tree AS i, subroot AS h FROM sub)")
    for k in range(top + 1, top + 1 + _SOURCE_LEVELS):
        level(k)
    last = top + 1 + _SOURCE_LEVELS
    came, proof, fold = "r", "''", "x.seen"
    for k in [*range(_ROW_LEVELS), *range(top + 1, last)]:
        node = f"p.tree = x.tree AND p.i = x.i // {16**k}" if k < top else f"p.tree = 0 AND p.i = x.tree // {16 ** (k - top - 1)}"
        steps.append(
            f"f{k} AS (SELECT x.rid, x.doc_id, x.tree, x.leaf, x.i, {proof} || p.l || p.g AS proof, "
            f"CASE WHEN p.more THEN sha256(p.l || {fold} || p.g) ELSE {fold} END AS fold FROM {came} x JOIN p{k} p ON {node})"
        )
        came, proof, fold = f"f{k}", "x.proof", "x.fold"
    return (
        f"WITH {', '.join(steps)} SELECT x.doc_id, x.leaf, sub.subroot, top.h AS root, sha256(x.proof) AS proof_sha256, x.fold AS folded_root, x.fold = top.h AS verified "
        f"FROM {came} x JOIN sub ON sub.tree = x.tree CROSS JOIN n{last} AS top"
    )


@_query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM (SELECT {_WORDS_SQL} AS w FROM benchmark)),
t AS {_CRC_TABLE},
v AS (SELECT word, {_crc_sql("hx")} % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM dw UNION SELECT word FROM bw)), t),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket),
b AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM dw) + 10000)
  / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN b USING (bucket)),
k AS (SELECT rid, sum(gain) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN k USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (rid)"""


@_query("op12_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)
