"""Merging change batches into a keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.operators.latest import dedup_latest, first_of


def as_state(batch: DataFrame) -> DataFrame:
    """State columns of change rows: value, sequence, transaction and the time of `ts` in milliseconds."""
    return batch.select("k", "v", F.col("seq").alias("log_seq"), F.col("tx").alias("tx_id"), F.timestamp_millis("ts").alias("updated_at"))


def conditional_delete(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state without the keys that a newer tombstone of the batch (one row per key) names."""
    gone = batch.where(F.coalesce("del", F.lit(False))).select(F.col("k").alias("_k"), F.col("seq").alias("_seq"))
    return state.join(gone, (F.col("k") == F.col("_k")) & (F.col("_seq") > F.col("log_seq")), "left_anti")


def conditional_upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state with the batch's puts; of an existing and a new row of a key, the new one wins only if its sequence is higher."""
    new = as_state(batch.where(~F.coalesce("del", F.lit(False))))
    both = state.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_of(both, ("k",), F.desc("log_seq"), F.asc("_new")).drop("_new")


def merge_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """B04's step: the batch's latest row per key, then C02, then C03. Rows without a key are dropped."""
    latest = dedup_latest(batch.where("k is not null"))
    return conditional_upsert(conditional_delete(state, latest), latest)


def fold_winners(last: DataFrame, order: str) -> DataFrame:
    """(k, order, seq): which row a left fold leaves of each key, from one row (k, order, seq, del) of a key and file, by `order`. Keys that end deleted are left out.

    What a key's fold holds is a few numbers for each file that has the key.
    """
    steps = F.array_sort(F.collect_list(F.struct(order, "seq", "del")))
    kind = last.schema[order].dataType.simpleString()
    empty = F.lit(None).cast(f"struct<at: {kind}, seq: bigint>")

    def step(state, x):
        newer = x["seq"] > state["seq"]
        put = F.struct(x[order].alias("at"), x["seq"].alias("seq"))
        return F.when(x["del"], F.when(state.isNotNull() & newer, empty).otherwise(state)).otherwise(F.when(state.isNull() | newer, put).otherwise(state))

    folded = last.groupBy("k").agg(F.aggregate(steps, empty, step).alias("s"))
    return folded.where("s is not null").select("k", F.col("s.at").alias(order), F.col("s.seq").alias("seq"))


def fold_files(log: DataFrame, order: str) -> DataFrame:
    """C02 and C03 over many files at once: for each key a left fold over the files in `order`, each with its latest row of the key.

    A hard delete forgets its sequence, so an older put in a later file brings the key back. Values stay out of the fold and join its winners.
    """
    last = dedup_latest(log.where("k is not null"), ("k", order))
    won = fold_winners(last.select("k", order, "seq", F.coalesce("del", F.lit(False)).alias("del")), order)
    return last.select("k", order, "seq", "v").join(won, ["k", order, "seq"]).select("k", "seq", "v")


def fold_into(state: DataFrame, batch: DataFrame, order: str = "file") -> DataFrame:
    """B04's step for many files: the rows of `state` that the batch's keys have after the files, in `order`, and `_gone` for keys that the state had and has no more.

    A state row is a put before all files. Only the batch's keys are read of the state.
    """
    columns = state.columns
    last = dedup_latest(batch.where("k is not null"), ("k", order))
    kept = state.join(last.select("k").distinct(), "k", "left_semi")
    new = last.select("k", "v", F.col("seq").alias("log_seq"), F.col("tx").alias("tx_id"), F.timestamp_millis("ts").alias("updated_at"), F.col(order), F.coalesce("del", F.lit(False)).alias("del"))
    both = kept.withColumns({order: F.lit(None).cast(last.schema[order].dataType), "del": F.lit(False)}).unionByName(new)
    won = fold_winners(both.select("k", order, F.col("log_seq").alias("seq"), "del"), order).select("k", F.col(order).alias("_at"), F.col("seq").alias("_seq"))
    met = (both["k"] == won["k"]) & both[order].eqNullSafe(won["_at"]) & (both["log_seq"] == won["_seq"])
    left = both.join(won, met, "left_semi").select(*columns, F.lit(False).alias("_gone"))
    gone = kept.join(won.select("k"), "k", "left_anti").select(*columns, F.lit(True).alias("_gone"))
    return left.unionByName(gone)


def replacing_merge(history: DataFrame, version: str = "log_seq") -> DataFrame:
    """C04's table form: the row of the highest version per key, tombstones kept as is_deleted."""
    return first_of(history, ("k",), F.desc(version))


def ungated(files: DataFrame, processed: DataFrame) -> DataFrame:
    """The files that were not processed yet, by name."""
    return files.join(processed.select("filename"), "filename", "left_anti")
