"""Versions of keys: the latest, the live ones, snapshots and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.plans.prefix import carried, crowded


def first_of(rows: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    """The first row of each key in an order. The filter on a rank drops all but one row of a key where they arise, before any shuffle, so no key is too frequent."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def collapse_transactions(statements: DataFrame) -> DataFrame:
    """The last statement per (tx, k)."""
    return first_of(statements, ("tx", "k"), F.desc("seq"))


def dedup_latest(log: DataFrame, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The row of the highest (seq, tx) per key, tombstones included."""
    return first_of(log, keys, F.desc("seq"), F.desc("tx"))


def live_state(log: DataFrame, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The latest rows that are no tombstones, whatever the order in which the log arrived."""
    return dedup_latest(log, keys).where(~F.coalesce(F.col("del"), F.lit(False)))


def snapshot_at(log: DataFrame, tx: int, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The live state as of a transaction."""
    return live_state(log.where(F.col("tx") <= tx), keys)


def key_count(log: DataFrame) -> DataFrame:
    """How many keys are live; values are not read."""
    return live_state(log.select("k", "seq", "tx", "del")).agg(F.count("*").alias("n"))


def key_count_by_delta(log: DataFrame, spread: bool | None = False) -> DataFrame:
    """C08, incrementally: +1 for a put of an absent key, -1 for a delete of a present one. `spread` as in version_chain."""
    rows = log.select("k", "seq", "del")
    if crowded(log, "k") if spread is None else spread:
        before = carried(rows.withColumn("_own", F.col("del")), "k", ["seq"], "_own", "_before", before=True)
    else:
        before = rows.withColumn("_before", F.lag("del").over(Window.partitionBy("k").orderBy("seq")))
    gone = F.coalesce("_before", F.lit(True))
    delta = F.when(F.col("del"), F.when(gone, 0).otherwise(-1)).otherwise(F.when(gone, 1).otherwise(0))
    return before.select(delta.alias("d")).agg(F.sum("d").cast("long").alias("n"))


def version_chain(log: DataFrame, spread: bool | None = False) -> DataFrame:
    """Every version with the transaction that ends it. With `spread`, a key's versions may be too many for one task; None: as measured."""
    if crowded(log, "k") if spread is None else spread:
        ended = carried(log.select("k", "tx"), "k", ["tx"], "tx", "valid_to", before=True, backwards=True)
        return ended.select("k", F.col("tx").alias("valid_from"), "valid_to")
    return log.select("k", F.col("tx").alias("valid_from"), F.lead("tx").over(Window.partitionBy("k").orderBy("tx")).alias("valid_to"))
