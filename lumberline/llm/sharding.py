"""Sampled splitters: size-weighted key samples cut the keys into ranges, which are dealt to shards by their bytes.

The key of a record is the hash of its text, then its id, then a row number.  Equal texts are thus
neighbours and stay in one shard unless they are too many for it.  A sample in which a record's
chance grows with its size gives quantile boundaries; ranges that turn out overfull are sampled
again and subdivided, inside a hot text as well.  Ranges are windows of bounded size: running byte
sums inside them, plus the bytes of the ranges before, place each record in the shards.

Nulls: a null text has no bytes, a null id sorts first.  Empty tables give no rows.  Repeated rows
are records of their own.  Only the id and the text are read of other columns, so that clashing
names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.common import staged

SEED = 2024


def _key(id_type: str, hashed: object, doc: object, tag: object) -> Column:
    lit = lambda v, kind: v if isinstance(v, Column) else F.lit(v).cast(kind)
    return F.struct(lit(hashed, "long").alias("h"), lit(doc, id_type).alias("d"), lit(tag, "long").alias("t"))


def _range_of(bounds: list[tuple], id_type: str) -> Column:
    """The number of splitters at or below the key of a row."""
    if not bounds:
        return F.lit(0)
    key = F.struct(F.col("h"), F.col("d"), F.col("t"))
    return F.size(F.filter(F.array(*[_key(id_type, *b) for b in bounds]), lambda b: b <= key))


def _sampled(rows: DataFrame, pieces: dict[int, tuple[int, int]], draws: int) -> list[tuple]:
    """Quantiles of size-weighted draws, for each range in ``pieces`` (its bytes, the pieces wanted)."""
    spark = rows.sparkSession
    plan = [(k, float(n * draws) / b, n) for k, (b, n) in pieces.items()]
    if len(plan) == 1:
        wanted = rows.where(F.col("part") == plan[0][0]).withColumns({"rate": F.lit(plan[0][1]), "n": F.lit(plan[0][2])})
    else:
        wanted = rows.join(F.broadcast(spark.createDataFrame(plan, "part int, rate double, n int")), "part")
    chance = F.pmod(F.xxhash64("h", "d", "t", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = wanted.where(chance < F.col("size") * F.col("rate"))
    weight = F.greatest(F.lit(1.0), F.col("size") * F.col("rate"))
    by_part = Window.partitionBy("part")
    running = by_part.orderBy("h", "d", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.select("part", "h", "d", "t", "n", weight.alias("w")).select(
        "part", "h", "d", "t", F.floor(F.coalesce(F.sum("w").over(running), F.lit(0.0)) * F.col("n") / F.sum("w").over(by_part)).alias("cut")
    )
    # A few hundred draws per shard at most, whatever the size of the table.
    cuts = placed.groupBy("part", "cut").agg(F.min(F.struct("h", "d", "t")).alias("k")).where("cut > 0").collect()
    return [(r.k.h, r.k.d, r.k.t) for r in cuts]


def _ordered(bounds: list[tuple]) -> list[tuple]:
    """Splitters in key order; the first inside a text moves to its first row, so that only texts with several are cut."""
    least = lambda b: (b[0], b[1] is not None, b[1] if b[1] is not None else 0, b[2])
    out: list[tuple] = []
    for bound in sorted(set(bounds), key=least):
        out.append(bound if out and out[-1][0] == bound[0] else (bound[0], None, -1))
    return out


def shard(df: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text: str = "text", per_shard: int = 4, draws: int = 64, rounds: int = 3) -> DataFrame:
    """Every record with its ``shard`` (bytes near equal) and its ``slot`` in it, gapless from 0."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = staged(
        df.select(
            F.col(f"`{id_col}`").alias("d"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("h"),
        ).withColumn("t", F.monotonically_increasing_id()),
        "shard-keys",
    )
    id_type = rows.schema["d"].dataType.simpleString()
    total = rows.agg(F.sum("size")).first()[0] or 1
    target = max(1, total // (shards * per_shard))

    bounds: list[tuple] = []
    pieces = {0: (total, shards * per_shard)}
    for _ in range(rounds):
        more = _sampled(rows.withColumn("part", _range_of(bounds, id_type)), pieces, draws)
        grown = _ordered([*bounds, *more])
        if grown == bounds:
            break
        bounds = grown
        full = rows.groupBy(_range_of(bounds, id_type).alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        pieces = {r.part: (r.bytes, -(-r.bytes // target)) for r in full if r.bytes > 2 * target and r.n > 1}
        if not pieces:
            break

    ranged = rows.withColumn("part", _range_of(bounds, id_type))
    inside = Window.partitionBy("part").orderBy("h", "d", "t")
    same = Window.partitionBy("part", "h")
    placed = ranged.withColumns({
        "before": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "row": F.row_number().over(inside).cast("long") - 1,
    }).withColumns({"text_bytes": F.sum("size").over(same), "text_start": F.min("before").over(same)})
    # One row per range.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("b").over(so_far), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("part_rows")
    )
    # A text of up to a fiftieth of a shard goes by its middle; a larger one is divided row by row.
    middle = F.when(F.col("text_bytes") * (50 * shards) <= total, 2 * F.col("text_start") + F.col("text_bytes")).otherwise(2 * F.col("before") + F.col("size"))
    dealt = staged(
        placed.join(F.broadcast(offsets), "part").select(
            F.col("d").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), (F.col("part_rows") + F.col("row")).alias("at"),
            F.least(F.lit(shards - 1), F.floor((2 * F.col("part_bytes") + middle) * F.lit(shards) / F.lit(2 * total)).cast("int")).alias("shard"),
        ),
        "shard-rows",
    )
    firsts = dealt.groupBy("shard").agg(F.min("at").alias("first"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
