"""Change-log views over the generated `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement: every event is a put of its properties, and an error event a delete."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        (F.floor(F.col("event_id") / 3) + 1).cast("long").alias("tx"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("k"),
        F.when(~gone, F.col("props")).alias("v"),
        gone.alias("del"),
        (F.col("user_id") % 4).alias("db"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("file_id"),
        F.col("ts"),
    )


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed log: of a transaction's statements on a key, only the last one counts."""
    from changelake.operators.latest import collapse_transactions

    return collapse_transactions(statements(spark, sf_dir))
