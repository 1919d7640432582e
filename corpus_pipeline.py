"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Toxic documents go, boilerplate lines go, one document of each group of near duplicates stays,
documents with benchmark passages go, and the rest is encoded.  All stages but the last return the
columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import bpe, dartminhash, decontaminate, lines, toxicity
from lumberline.llm.catalog import BPE_RANKS
from lumberline.llm.common import table
from lumberline.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.  Null and empty texts score as texts without any mark do."""
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    carried = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    scored = toxicity.toxicity(carried, index, carry=("__row",))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` follows a changed text."""
    cleaned = lines.drop_boilerplate(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])))

    def column(name: str) -> Column:
        own = F.col(f"__row.`{name}`")
        if name == "text":
            return F.col("text").alias(name)
        if name == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(own).alias(name)
        return own.alias(name)

    return cleaned.select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id.  Rows that are equal in id and text count as copies."""
    classes = dartminhash.near_duplicates(docs)
    kept = classes.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    alone = F.col("text").isNull()
    key = F.md5(F.col("text").cast("string").cast("binary"))
    texts = docs.where(~alone).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_semi")
    # Ids are unique as a rule; where id and text are not, one row stays.
    repeated = classes.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        texts = texts.withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return texts.unionByName(docs.where(alone))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    carried = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = decontaminate.contamination(carried, table(spark, sf_dir, "benchmark"), carry=("__row",))
    return found.where("n_hit = 0").select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each text and the digests of its ids and of the decoded bytes."""
    return bpe.round_trip(docs, BPE_RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot say the toxicity, near-duplicate and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
