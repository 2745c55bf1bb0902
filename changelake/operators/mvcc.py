"""Reads and writes at snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.operators.latest import live_state
from changelake.plans.prefix import carried, crowded, numbered
from changelake.schemas import UNBOUNDED


def as_of_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (k, read_tx) the newest version up to it; a tombstone or a missing key gives a null value.

    Versions become intervals [tx, next tx), so the join is an equi-join on k with a range condition.
    """
    ends = F.coalesce(F.lead("tx").over(Window.partitionBy("k").orderBy("tx")), F.lit(UNBOUNDED))
    spans = log.select(F.col("k").alias("_k"), "v", "del", "tx", ends.alias("_end"))
    found = probes.join(spans, (F.col("k") == F.col("_k")) & (F.col("tx") <= F.col("read_tx")) & (F.col("read_tx") < F.col("_end")), "left")
    return found.select(*probes.columns, F.when(~F.col("del"), F.col("v")).alias("v"), F.col("tx").alias("version"))


def as_of_get_union(log: DataFrame, probes: DataFrame, spread: bool | None = False) -> DataFrame:
    """C05 in one pass over log and probes together, for keys with so many versions and probes that a join would multiply them.

    With `spread`, they may be too many for one task as well; None: as measured.
    """
    kind = "struct<v: string, del: boolean, tx: bigint>"
    entries = log.select("k", F.col("tx").alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast("bigint").alias("read_tx"), F.struct("v", "del", "tx").cast(kind).alias("_e"))
    asked = probes.select("k", F.col("read_tx").alias("_at"), F.lit(1).alias("_probe"), "read_tx", F.lit(None).cast(kind).alias("_e"))
    both = entries.unionByName(asked)
    if crowded(both, "k") if spread is None else spread:
        found = carried(both, "k", ["_at", "_probe"], "_e", "_last").drop("_e").withColumnRenamed("_last", "_e").where("_probe = 1")
    else:
        last = F.last("_e", ignorenulls=True).over(Window.partitionBy("k").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("_e", last).where("_probe = 1")
    return found.select("k", "read_tx", F.when(~F.col("_e.del"), F.col("_e.v")).alias("v"), F.col("_e.tx").alias("version"))


def read_own_writes(log: DataFrame, probes: DataFrame, pending: DataFrame) -> DataFrame:
    """C05 within a transaction: its own pending puts and deletes (k, v, del) come before the snapshot. `own` marks what they served."""
    own = pending.select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.col("del").alias("_del"))
    found = as_of_get(log, probes).join(own, F.col("k") == F.col("_k"), "left")
    served = F.col("_k").isNotNull()
    return found.select(*probes.columns, F.when(served, F.when(~F.col("_del"), F.col("_v"))).otherwise(F.col("v")).alias("v"), served.alias("own"))


def multi_get(log: DataFrame, keys: list[str], read_tx: int | None = None) -> DataFrame:
    """The values of a request's keys in its order, repeats included; null for those not found."""
    spark = log.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, k string")
    state = live_state(log if read_tx is None else log.where(F.col("tx") <= read_tx))
    return wanted.join(state.select("k", "v"), "k", "left").orderBy("pos").select("pos", "k", "v")


def get_latest(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest committed values of `keys` (k)."""
    return keys.join(live_state(log).select("k", "v", "tx"), "k", "left")


def delete_count(log: DataFrame, keys: DataFrame) -> DataFrame:
    """C11: how many distinct keys of a delete request exist; every listed key gets a tombstone in any case."""
    return keys.select("k").distinct().join(live_state(log.select("k", "seq", "tx", "del")), "k", "left_semi").agg(F.count("*").alias("n"))


def clocks(log: DataFrame) -> DataFrame:
    """The transaction and operation clocks: the highest of each, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("tx"), F.lit(0)).alias("tx"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def write_batch(log: DataFrame, writes: DataFrame) -> DataFrame:
    """C11/C17: log rows of one new transaction from `writes` (k, v, del), numbered after the log's clocks in the order of k."""
    rows = numbered(writes.select("k", "v", "del").dropDuplicates(["k"]), ["k"], "_n")
    now = clocks(log)
    return rows.crossJoin(F.broadcast(now)).select((F.col("seq") + F.col("_n")).alias("seq"), (F.col("tx") + 1).alias("tx"), "k", "v", "del")


def apply_batch(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with externally numbered rows; its clocks become the higher ones."""
    return log.unionByName(batch)


def restore_replay(backup: DataFrame, tx: int, seq: int) -> DataFrame:
    """C14: the state of a backup's records: of a key the last one by position counts, tombstones go, all rows have the backup's numbers."""
    last = backup.groupBy("k").agg(F.max_by(F.struct("v", "del"), "pos").alias("r"))
    return last.where("not r.del").select("k", F.col("r.v").alias("v"), F.lit(seq).cast("bigint").alias("seq"), F.lit(tx).cast("bigint").alias("tx"))


def rebuild_index(values: DataFrame) -> DataFrame:
    """The location of every (k, tx) in the value log: the last record of each."""
    best = values.groupBy("k", "tx").agg(F.max_by(F.struct("file_id", "offset", "op", "del"), "op").alias("r"))
    return best.select("k", "tx", "r.*")


def replay_gap(wal: DataFrame, values: DataFrame) -> DataFrame:
    """The log's rows of transactions that the value log does not have yet."""
    high = values.agg(F.coalesce(F.max("tx"), F.lit(0)).alias("_high"))
    return wal.crossJoin(F.broadcast(high)).where("tx > _high").drop("_high")


def tx_collapse_count(statements: DataFrame) -> DataFrame:
    """How many statements each transaction had and how many of them count."""
    return statements.groupBy("tx").agg(F.count("*").alias("statements"), F.count_distinct("k").alias("kept"))
