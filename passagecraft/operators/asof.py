"""As-of joins of two tables: for each row the last row of another at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import kept


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """left with ``found``, a struct of right's row with the greatest ``right_at`` that is not over ``left_at`` (``strict``: under it), among rows equal in ``by``.

    Both tables become one, sorted by key and place and dealt over tasks by ranges of that order, so the rows of a hot key
    are in as many tasks as they need. Within a range the last row of right is carried forward; what stands last at a
    range's end is one row a key, and is carried over to the ranges behind it. Of rows of right at one place the greatest
    counts, column by column. Rows of left without a match, or with a null place or key, have null; rows of right with a
    null place or key are no match. Every row of left is there as often as before. The sorted rows are written to the
    shared folder, as all looks must see the same ranges.
    """
    keys = [f"asof_by{i}" for i in range(len(by))]
    # at one place rows of right come first, unless only those under it count
    of_left, of_right = (0, 1) if strict else (1, 0)

    def side(df: DataFrame, at: str, number: int, mine: str, other: str, others: DataFrame) -> DataFrame:
        named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
        return df.select(*named, F.col(at).alias("asof_at"), F.lit(number).alias("asof_side"), F.struct(*df.columns).alias(mine), F.lit(None).cast(others.schema).alias(other))

    a, b = side(left, left_at, of_left, "l", "r", right), side(right, right_at, of_right, "r", "l", left)
    whole = lambda df: df.where(" and ".join(f"{c} is not null" for c in [*keys, "asof_at"]))
    both = whole(a).unionByName(whole(b))
    order = [*map(F.col, keys), F.col("asof_at"), F.col("asof_side"), F.col("r")]
    dealt = both.withColumn("asof_line", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("asof_line")).withColumn("asof_part", F.spark_partition_id()).drop("asof_line")
    rows = kept(dealt, "asof")
    here = W.partitionBy("asof_part", *keys)
    carried = rows.withColumn("own", F.last("r", ignorenulls=True).over(here.orderBy("asof_at", "asof_side", "r").rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("asof_side") == of_left)
    ends = rows.groupBy("asof_part", *keys).agg(F.max(F.when(F.col("asof_side") == of_right, F.struct("asof_at", "r"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("asof_part").rowsBetween(W.unboundedPreceding, -1))
    over = ends.withColumn("over", before).select("asof_part", *keys, F.col("over.r").alias("over")).where("over is not null")
    found = carried.join(over, ["asof_part", *keys], "left").select("l.*", F.coalesce("own", "over").alias("found"))
    return found.unionByName(left.where(" or ".join(f"{c} is null" for c in [*by, left_at])).withColumn("found", F.lit(None).cast(right.schema)))
