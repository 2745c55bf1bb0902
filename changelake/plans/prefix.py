"""Running totals and numbers over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.session import durable


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`, the sum of `value` over all rows up to this one in `order`, which must have no ties.

    Rows are dealt into ranges of the order, totals are made within ranges, and the few range totals are summed and added.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    # One row per range, and ranges are as many as shuffle partitions.
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    summed = ranged.withColumn(out, F.sum(value).over(within)).join(F.broadcast(before), "_range")
    return summed.withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_range", "_before")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with `out`, the row's number from 1 in `order`."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out).drop("_one")


def carried(df: DataFrame, key: str, order: list[str], value: str, out: str, before: bool = False, backwards: bool = False) -> DataFrame:
    """df with `out`, the last value that is not null of the row's key in `order`: up to the row, or with `before` up to the one before it; with `backwards` in the other direction.

    The rows of a key may be a third of all: they are dealt into ranges of (key, order), so a key takes as many tasks as it needs. A window serves within ranges, and
    only a range's first key needs what earlier ranges know of it, which is one row per range.
    """
    ranged = durable(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    direction = [F.desc(c) if backwards else F.asc(c) for c in order]
    window = Window.partitionBy("_range", key).orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    low, high = (F.max, F.min) if backwards else (F.min, F.max)
    leaving = ranged.groupBy("_range").agg(high(key).alias(key))
    pick = F.min_by if backwards else F.max_by
    known = ranged.join(F.broadcast(leaving), ["_range", key]).where(F.col(value).isNotNull()).groupBy(F.col("_range").alias("_from"), F.col(key).alias("_key")).agg(pick(value, F.struct(*order)).alias("_value"))
    entering = ranged.groupBy("_range").agg(low(key).alias("_key"))
    earlier = F.col("_from") > F.col("_range") if backwards else F.col("_from") < F.col("_range")
    carry = entering.join(F.broadcast(known), "_key").where(earlier).groupBy("_range", "_key").agg(pick("_value", "_from").alias("_value")).withColumnRenamed("_range", "_to")
    met = ranged.withColumn(out, F.last(value, ignorenulls=True).over(window)).join(F.broadcast(carry), (F.col("_range") == F.col("_to")) & (F.col(key) == F.col("_key")), "left")
    return met.withColumn(out, F.coalesce(out, "_value")).drop("_range", "_to", "_key", "_value")


#: Rows of one key that a task may sort.
CROWDED = 5_000_000


def crowded(df: DataFrame, key: str, most: int = CROWDED) -> bool:
    """Whether some key has more rows than a task should sort. Only keys are read, and counted before the shuffle."""
    top = df.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (top or 0) > most
