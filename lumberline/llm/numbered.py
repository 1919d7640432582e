"""Places of rows in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.common import staged

#: ``monotonically_increasing_id`` has the partition above this bit and the row within it below.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str, *, within: Sequence[str] = (), place: str = "place") -> DataFrame:
    """Adds ``place``: how many rows of the same ``within`` values stand before a row, which come first in the order.

    A range sort spreads any one value over many partitions.  What a window would need of all rows is
    one count per partition and value; these are summed up and joined back.  Null is a value like any other.
    """
    taken = staged(df.orderBy(*[F.col(c).asc_nulls_first() for c in within], *order).withColumn("__id", F.monotonically_increasing_id()), name)
    part = F.shiftright("__id", _ROW_BITS)
    # One row per partition and value: the partitions of a sort, and the values that lie in each.
    counts = staged(taken.groupBy(part.alias("__part"), *within).agg(F.min("__id").alias("__first"), F.count("*").alias("__n")), f"{name}-counts")
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: f"__of_{i}" for i, c in enumerate(within)}
    spans = staged(
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first").withColumnsRenamed(renamed),
        f"{name}-spans",
    )
    on = part == F.col("__part")
    for c, other in renamed.items():
        on &= F.col(c).eqNullSafe(F.col(other))
    return taken.join(spans, on).withColumn(place, F.col("__id") + F.col("__before")).drop("__id", "__part", "__before", *renamed.values())
