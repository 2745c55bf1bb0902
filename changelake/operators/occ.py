"""Optimistic concurrency: conflicts, group commit and numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.operators.mvcc import clocks
from changelake.plans.prefix import carried, crowded, running

#: Requests in a group commit at most; seconds that a transaction may take.
GROUP, LONGEST = 128, 30


def touched(requests: DataFrame) -> DataFrame:
    """(txid, read_tx, k) of all keys that requests read or write; keys served from own writes are not in `reads`."""
    keys = F.array_union("reads", F.transform("writes", lambda w: w["k"]))
    return requests.select("txid", "read_tx", F.explode(keys).alias("k"))


def begin(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests with the snapshot that they read, which is the log's transaction clock; one row of a clock is broadcast."""
    return requests.drop("read_tx").crossJoin(F.broadcast(clocks(log).select(F.col("tx").alias("read_tx"))))


def conflicts(touched: DataFrame, log: DataFrame, until: str | None = None, spread: bool | None = False) -> DataFrame:
    """For each request with one, how many of its keys have a version after its snapshot (and before the column `until`).

    Without an upper bound the log is reduced to its latest version per key. With one, each request takes the next version of its key after its snapshot, by
    one window over both; so a key's history is never multiplied with its requests. With `spread`, they may be too many for one task; None: as measured.
    """
    if until is None:
        latest = log.groupBy(F.col("k").alias("_k")).agg(F.max("tx").alias("_tx"))
        hit = touched.join(latest, (F.col("k") == F.col("_k")) & (F.col("_tx") > F.col("read_tx")), "left_semi")
        return hit.groupBy("txid").agg(F.count_distinct("k").alias("bad_keys"))
    none = F.lit(None).cast("bigint")
    versions = log.select("k", F.col("tx").alias("_at"), F.lit(0).alias("_probe"), none.alias("txid"), none.alias("_until"), F.col("tx").alias("_tx"))
    asked = touched.select("k", F.col("read_tx").cast("bigint").alias("_at"), F.lit(1).alias("_probe"), F.col("txid").cast("bigint").alias("txid"), F.col(until).cast("bigint").alias("_until"), none.alias("_tx"))
    both = versions.unionByName(asked)
    # Backwards from the newest, probes come before versions of their own transaction.
    if crowded(both, "k") if spread is None else spread:
        met = carried(both, "k", ["_at", "_probe"], "_tx", "_next", backwards=True)
    else:
        order = Window.partitionBy("k").orderBy(F.desc("_at"), F.desc("_probe")).rowsBetween(Window.unboundedPreceding, 0)
        met = both.withColumn("_next", F.last("_tx", ignorenulls=True).over(order))
    return met.where("_probe = 1 and _next < _until").groupBy("txid").agg(F.count_distinct("k").alias("bad_keys"))


def batched(requests: DataFrame, size: int = GROUP) -> DataFrame:
    """The number of each request's group commit, by arrival from 1."""
    return requests.withColumn("batch", F.floor((F.col("arrival") - 1) / size).cast("bigint"))


OUTCOMES = "txid bigint, arrival bigint, outcome string, n_ops bigint"


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outcomes of rows that are sorted by database and arrival: what a committer holds is the last writer of each key, nothing of the requests."""
    db, last, number = object(), {}, 0
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        outcome, ops = [], []
        for i in range(batch.num_rows):
            if c["db"][i] != db:
                db, last, number = c["db"][i], {}, c["head"][i]
            group, read, writes = c["batch"][i], c["read_tx"][i], set(c["writes"][i])
            # A read-only request commits nothing and never conflicts.
            ok = not writes
            if writes and not c["stale"][i]:
                met = (last[k] for k in {*writes, *c["reads"][i]} if k in last)
                ok = not any(g == group or read is None or tx > read for tx, g in met)
                if ok:
                    number += 1
                    last.update(dict.fromkeys(writes, (number, group)))
            outcome.append("ok" if ok else "conflict")
            ops.append(len(writes) if ok else 0)
        yield pa.RecordBatch.from_arrays([batch.column("txid"), batch.column("arrival"), pa.array(outcome, pa.string()), pa.array(ops, pa.int64())], names=["txid", "arrival", "outcome", "n_ops"])


def commit(requests: DataFrame, log: DataFrame, size: int = GROUP) -> DataFrame:
    """E04 after E03: the outcome of every request (db, arrival, txid, read_tx, reads, writes) against the log and the survivors before it.

    Groups have `size` requests. A request conflicts with any survivor of its own group that writes one of its keys, and with one of an earlier group if
    that one's transaction, numbered after the log's head, is after the request's snapshot. Whether a request survives depends on all before it, so each
    database has one committer: its requests stream through one task in the order of arrival and are never held; its memory is the keys that were written.
    """
    stale = conflicts(touched(requests), log).select("txid", F.lit(True).alias("stale"))
    asked = batched(requests, size).join(stale, "txid", "left").crossJoin(F.broadcast(clocks(log).select(F.col("tx").alias("head"))))
    wanted = asked.select("db", "arrival", "txid", "read_tx", "batch", "head", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("reads", F.array()).alias("reads"), F.coalesce(F.transform("writes", lambda w: w["k"]), F.array()).alias("writes"))
    return wanted.repartition("db").sortWithinPartitions("db", "arrival").mapInArrow(_decided, OUTCOMES)


def numbering(survivors: DataFrame, order: str = "txid", ops: str = "n") -> DataFrame:
    """Consecutive transaction numbers and first operation numbers of survivors with operations; others take none."""
    some = survivors.where(F.col(ops) > 0).withColumn("_one", F.lit(1).cast("bigint"))
    counted = running(running(some, [order], "_one", "new_tx"), [order], ops, "_upto")
    return counted.select(order, "new_tx", (F.col("_upto") - F.col(ops) + 1).alias("start_op"))


def timed_out(transactions: DataFrame, seconds: int = LONGEST) -> DataFrame:
    """Transactions (begin_ts, commit_ts) that took too long to commit."""
    return transactions.where(F.col("commit_ts") - F.col("begin_ts") > F.expr(f"interval {seconds} seconds"))


#: What roles may send, by opcode; which states allow reads, writes and new transactions; what a transaction may not hold.
SESSION = ("ping", "quit", "hello")
DATA = ("begin", "commit", "abort", "get", "set", "del", "mget", "mset", "mdel", "select", "stat")
ADMIN = ("replicaof", "promote", "stepdown", "checkpoint", "flushdb")
STATES = (("UNDEFINED", False, False, False), ("REPLICA", True, False, True), ("PRIMARY", True, True, True), ("STEPPING_DOWN", True, True, False))
NOT_IN_TX = ("select", "replicaof", "stepdown", "promote", "flushdb", "checkpoint", "stat", "quit")


def role_table(spark) -> DataFrame:
    """(role, op, allowed)."""
    ops = [*SESSION, *DATA, *ADMIN]
    rows = [(r, o, r in ("admin", "server") or (r == "client" and (o in DATA or o in SESSION[:2])) or (r == "cdc" and o in SESSION)) for r in ("admin", "server", "client", "cdc") for o in ops]
    return spark.createDataFrame(rows, "role string, op string, allowed boolean")


def state_table(spark) -> DataFrame:
    """(state, can_read, can_write, can_begin)."""
    return spark.createDataFrame(list(STATES), "state string, can_read boolean, can_write boolean, can_begin boolean")


def in_tx_table(spark) -> DataFrame:
    """(op, allowed) within a transaction."""
    return spark.createDataFrame([(o, o not in NOT_IN_TX) for o in (*SESSION, *DATA, *ADMIN)], "op string, allowed boolean")


def gated(commands: DataFrame) -> DataFrame:
    """Commands (role, state, op, in_tx) with whether role, state and transaction allow them."""
    spark = commands.sparkSession
    reads, writes = F.col("op").isin("get", "mget"), F.col("op").isin("set", "del", "mset", "mdel")
    state = F.when(reads, F.col("can_read")).when(writes, F.col("can_write")).when(F.col("op") == "begin", F.col("can_begin")).otherwise(True)
    found = commands.join(F.broadcast(role_table(spark)), ["role", "op"], "left").join(F.broadcast(state_table(spark)), "state", "left")
    inside = ~F.col("in_tx") | ~F.col("op").isin(*NOT_IN_TX)
    return found.select(*commands.columns, (F.coalesce("allowed", F.lit(False)) & F.coalesce(state, F.lit(False)) & inside).alias("ok"))

