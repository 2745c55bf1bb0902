"""Garbage, compaction and obsolete files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.plans.prefix import carried, crowded

#: Bytes of a value-log record besides key and value; least garbage of a file to be compacted.
RECORD, LEAST = 29, 1 << 20


def record_size():
    """Bytes of a record in the value log; a tombstone has no value."""
    return F.lit(RECORD) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))


def garbage(log: DataFrame, spread: bool | None = False) -> DataFrame:
    """Bytes that each file holds of versions that a later one has replaced. With `spread`, a key's versions may be too many for one task; None: as measured."""
    order = Window.partitionBy("k").orderBy("seq")
    if crowded(log, "k") if spread is None else spread:
        own = log.select("k", "seq", F.struct("file_id", record_size().alias("size")).alias("own"))
        before = carried(own, "k", ["seq"], "own", "old", before=True).select("old.file_id", "old.size")
        return before.where("file_id is not null").groupBy("file_id").agg(F.sum("size").cast("bigint").alias("garbage"))
    before = log.select("k", "seq", "file_id", record_size().alias("size")).select(F.lag("file_id").over(order).alias("file_id"), F.lag("size").over(order).alias("size"))
    return before.where("file_id is not null").groupBy("file_id").agg(F.sum("size").cast("bigint").alias("garbage"))


def compaction_pick(log: DataFrame, least: int = LEAST) -> DataFrame:
    """The file with the most garbage, if it has at least `least`; never the active one, which is the last. Ties go to the lower number."""
    active = log.agg(F.max("file_id").alias("_active"))
    found = garbage(log).join(F.broadcast(active), F.col("file_id") != F.col("_active")).where(F.col("garbage") >= least)
    return found.orderBy(F.desc("garbage"), "file_id").limit(1).select("file_id", F.col("garbage").alias("g"))


def flagged(log: DataFrame) -> DataFrame:
    """The log with `alive`, true for the newest version of each key."""
    newest = log.groupBy(F.col("k").alias("_k")).agg(F.max(F.struct("tx", "seq")).alias("_top"))
    return log.join(newest, F.col("k") == F.col("_k")).withColumn("alive", (F.col("tx") == F.col("_top.tx")) & (F.col("seq") == F.col("_top.seq"))).drop("_k", "_top")


def liveness(log: DataFrame) -> DataFrame:
    """How many entries of each file are alive and how many are not."""
    alive = F.col("alive").cast("bigint")
    return flagged(log.select("k", "tx", "seq", "file_id")).groupBy("file_id").agg(F.sum(alive).alias("alive"), F.sum(1 - alive).alias("stale"))


def compact(log: DataFrame, files: list[int], into: int, horizon: int | None = None, spread: bool | None = False) -> DataFrame:
    """The log after a compaction of `files`: their live entries are in file `into`, the others are gone.

    Versions that a reader at transaction `horizon` or later can see stay: those whose successor is after the horizon. `spread` as in garbage.
    """
    if crowded(log, "k") if spread is None else spread:
        ended = carried(log.withColumn("_own", F.col("tx")), "k", ["tx", "seq"], "_own", "_end", before=True, backwards=True).drop("_own")
    else:
        ended = log.withColumn("_end", F.lead("tx").over(Window.partitionBy("k").orderBy("tx", "seq")))
    kept = ended.withColumn("_in", F.col("file_id").isin(files))
    seen = F.col("_end").isNull() if horizon is None else F.col("_end").isNull() | (F.col("_end") > horizon)
    return kept.where(~F.col("_in") | seen).withColumn("file_id", F.when(F.col("_in"), F.lit(into).cast("bigint")).otherwise(F.col("file_id"))).select(*log.columns)


def deletable(obsolete: DataFrame, readers: DataFrame, now: int) -> DataFrame:
    """Files (file_id, obsolete_at) that no reader (read_tx) needs any more; without readers, those obsolete up to now."""
    least = readers.agg(F.coalesce(F.min("read_tx"), F.lit(now + 1)).alias("_least"))
    return obsolete.join(F.broadcast(least), F.col("obsolete_at") < F.col("_least")).select("file_id")


def reset(log: DataFrame, db: int) -> DataFrame:
    """The log without a database."""
    return log.where(F.col("db") != db)
