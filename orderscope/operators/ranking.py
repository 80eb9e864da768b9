"""Global ranks by range partitioning and prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.session import scratch_path

_IN_PARTITION = 33  # bits of a row's place within its partition in monotonically_increasing_id()


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank", place: str = "_place") -> DataFrame:
    """``rows`` with their position from 1 in ``order``, which must tell all rows apart.

    Rows are range-partitioned by the whole order, so rows equal in its first columns are
    split over tasks like any others, and sorted within their partition. They are written
    once (a second computation could cut the ranges elsewhere); each knows its partition
    and its place there, and the rows of all earlier partitions are counted before it: one
    number for each partition.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranked")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, inside = F.shiftright(place, _IN_PARTITION), F.col(place).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return joined.withColumn(rank, (F.col("_before") + inside + 1).cast("bigint")).drop("_part", "_before", place)
