"""Exact positions in a group, without holding the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import settle

# Rows that one window partition may hold before its group is cut into more buckets.
BUCKET_ROWS = 100_000


def rank_in_buckets(df: DataFrame, group: list[str], bucket: Column, order: list, out: str = "rn",
                    at_most: int | None = None) -> DataFrame:
    """``row_number`` over ``group`` by ``order``, computed per bucket.

    ``bucket`` never falls as ``order`` rises, so the position of a row is its position in its bucket
    plus the rows of all lower buckets. Only counts per bucket cross buckets; a group with a third of
    all rows is spread over all its buckets. ``at_most`` skips buckets that start beyond it.
    """
    keyed = df.withColumn("_bucket", bucket)
    below = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(below), F.lit(0)))
        .drop("_rows")
    )
    if at_most is not None:
        offsets = offsets.filter(F.col("_offset") < at_most)
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)).cast("bigint")
    if at_most is None:
        # Window first: its shuffle on (group, bucket) also serves the join.
        ranked = keyed.withColumn(out, inside).join(offsets, [*group, "_bucket"])
        return ranked.withColumn(out, F.col(out) + F.col("_offset")).drop("_bucket", "_offset")
    ranked = keyed.join(offsets, [*group, "_bucket"]).withColumn(out, inside + F.col("_offset"))
    return ranked.filter(F.col(out) <= at_most).drop("_bucket", "_offset")


def rank_by_draw(df: DataFrame, group: list[str], draw: Column, out: str = "rn", size: str = "n_rows",
                 bucket_rows: int = BUCKET_ROWS, at_most: int | None = None) -> DataFrame:
    """Position of each row in the random order of its group (1-based), and the group's row count.

    A group is cut by the leading hex digits of the draw, as many as its size needs. Draws are
    uniform, so buckets are even however skewed the groups are.
    """
    keyed = df.withColumn("_draw", draw)
    if group:
        # Settled, so that Catalyst broadcasts the sizes only while they are measured to be small.
        sizes = settle(keyed.groupBy(*group).agg(F.count(F.lit(1)).alias(size)), "sizes")
        sized = keyed.join(sizes, group)
    else:
        total = df.agg(F.count(F.lit(1))).scalar()
        sized, group = keyed.withColumn(size, total).withColumn("_all", F.lit(0)), ["_all"]
    digits = F.greatest(F.ceil(F.log(F.col(size) / F.lit(float(bucket_rows))) / F.log(F.lit(16.0))), F.lit(0))
    bucket = F.substr("_draw", F.lit(1), digits.cast("int"))
    return rank_in_buckets(sized, group, bucket, ["_draw"], out, at_most).drop("_draw", "_all")


def dense_index(values: DataFrame, column: str, out: str, partitions: int = 200) -> DataFrame:
    """0-based index of the sorted distinct values of a column.

    The dictionary is range-partitioned, written, and numbered per range plus the counts of the lower ranges; no
    task holds all of it.
    """
    distinct = values.select(column).distinct()
    ranged = settle(
        distinct.repartitionByRange(partitions, column).withColumn("_range", F.spark_partition_id()), "dictionary"
    )
    # Ranges follow the order of the column, so the range id is an order-preserving bucket.
    ranked = rank_in_buckets(ranged.withColumn("_all", F.lit(0)), ["_all"], F.col("_range"), [column], out)
    return ranked.withColumn(out, F.col(out) - 1).select(column, out)
