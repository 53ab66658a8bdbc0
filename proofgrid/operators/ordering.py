"""Global order, rank and running sums without a window over all rows or over all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def _ranges(rows: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    """rows in ranges of the order, each range a number _part. They are cut at sampled places, so they are written once."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows with their 1-based number in a total order.

    Ranges of the order are sorted apart; each row's number within its range is added to the sizes of the ranges
    before it. Only one count for each range meets in one place.
    """
    columns = [F.col(c) for c in order]
    ranged = _ranges(rows, columns, parts)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")  # parts rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def numbered_within(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their 0-based number _i in the order within their group and the group's size _n; null keys are a group.

    Rows get their place in a sorted range as it is written. A range's piece of a group begins at the sizes of the
    pieces before it: a row for each range and group in it, so no group is sorted in one task, nor shuffled again.
    """
    columns = [F.col(c) for c in (*group, *order)]
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns).sortWithinPartitions(*columns)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), "ranges")
    keys = [f"_k{k}" for k in range(len(group))]
    pieces = ranged.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)]).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    of_group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(of_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, so that its size is known and it is sent to the rows where it is small.
    carried = stored(pieces.select("_p", *keys, (before - F.col("_first")).alias("_shift"), F.sum("_size").over(of_group).alias("_n")), "pieces")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys, strict=True)]
    joined = ranged.join(carried, [F.col("_part") == F.col("_p"), *same])
    return joined.select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("_i"), "_n")


def running(rows: DataFrame, group: Sequence[str], order: Column, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """rows with, for each name: value of sums, the sum of value over the rows of the group before this one in the order.

    The order tells the rows of a group apart. Ranges of (group, order) are summed up apart; a range that begins
    inside a group adds what the ranges before it hold of that group. So a group is split over as many tasks as it
    has ranges, and what meets in one place is one row for each range and group in it, of which few span ranges.
    """
    ranged = _ranges(rows.withColumn("_order", order), [*map(F.col, group), F.col("_order")], parts)
    key = [F.struct(*group).alias("_group")] if group else [F.lit(0).alias("_group")]
    inside = Window.partitionBy("_part", *group).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *key).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    # Only a range's last group goes on in the next one, so the ranges that a group spans are its carriers.
    across = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", "_group", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_{n}") for n in sums])
    here = ranged.select("*", *key, *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in sums.items()])
    joined = here.join(carried.withColumnRenamed("_part", "_p").withColumnRenamed("_group", "_g"), (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
