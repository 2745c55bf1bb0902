"""Replica slots: floors, quorum, lag, eviction, and the role machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.session import durable


def min_slot(slots: DataFrame) -> DataFrame:
    """the lowest position of all slots, connected or not; null without any."""
    return slots.agg(F.min("log_seq").alias("m"))


def quorum(slots: DataFrame, replicas: int) -> DataFrame:
    """what at least `replicas` servers have acknowledged, null if there are fewer. Slots are as many as replicas, so one window is small."""
    ranked = slots.where("role = 'server'").select("log_seq", F.row_number().over(Window.orderBy(F.desc("log_seq"))).alias("_rank"))
    return ranked.where(F.col("_rank") == replicas).agg(F.max("log_seq").alias("committed"))


def lag(slots: DataFrame, head: DataFrame) -> DataFrame:
    """the least and the largest distance from the head (head), 0 at least."""
    behind = F.greatest(F.col("head") - F.col("log_seq"), F.lit(0))
    return slots.join(F.broadcast(head)).agg(F.min(behind).cast("bigint").alias("lag"), F.max(behind).cast("bigint").alias("mx"))


def zombies(slots: DataFrame, head: DataFrame, now=None, minutes: int = 1) -> DataFrame:
    """slots that lag and were last seen over a minute ago; without `now`, those that lag."""
    late = F.col("log_seq") < F.col("head")
    if now is not None:
        late &= F.col("last_seen") < now - F.expr(f"interval {minutes} minutes")
    return slots.join(F.broadcast(head), late).select(*slots.columns)


def slots_of(events: DataFrame) -> DataFrame:
    """slots from events (db, replica_id, at, kind, role, log_seq): a registration resets, acknowledgements only raise, every event is a sign of life."""
    registered = events.where("kind = 'register'").groupBy("db", "replica_id").agg(F.max("at").alias("_since"), F.max_by("role", "at").alias("role"))
    since = events.drop("role").join(registered, ["db", "replica_id"]).where("at >= _since")
    gone = F.max_by("kind", "at") == "unregister"
    return since.groupBy("db", "replica_id", "role").agg(F.max("log_seq").alias("log_seq"), F.max("at").alias("last_seen"), (~gone).alias("connected"))


def healthy(slots: DataFrame) -> DataFrame:
    """how many connected servers there are."""
    return slots.agg(F.count_if(F.col("connected") & (F.col("role") == "server")).alias("n"))


def snapshot_required(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (replica_id, req) that the log can no longer serve: behind the head, and the next operation purged."""
    ends = log.agg(F.max("seq").alias("_head"), F.min("seq").alias("_first"))
    needed = (F.col("req") < F.col("_head")) & (F.col("req") + 1 < F.col("_first"))
    return requests.join(F.broadcast(ends)).select(*requests.columns, F.coalesce(needed, F.lit(False)).alias("snapshot"))


#: The state after an event, for the states in which it is allowed.
MOVES = {
    ("UNDEFINED", "replicaof"): "REPLICA", ("UNDEFINED", "promote"): "PRIMARY", ("REPLICA", "promote"): "PRIMARY", ("PRIMARY", "stepdown"): "STEPPING_DOWN", ("STEPPING_DOWN", "drained"): "UNDEFINED", ("REPLICA", "stepdown"): "UNDEFINED",
    ("UNDEFINED", "flushdb"): "UNDEFINED", ("REPLICA", "flushdb"): "UNDEFINED", ("PRIMARY", "flushdb"): "UNDEFINED", ("STEPPING_DOWN", "flushdb"): "UNDEFINED",
}


NAMES = ("UNDEFINED", "REPLICA", "PRIMARY", "STEPPING_DOWN")


def states(events: DataFrame) -> DataFrame:
    """the state of each database after its events (db, at, event), from UNDEFINED; events that a state does not allow change nothing.

    A run of events is a function from states to states, and these compose. So the events are dealt into ranges of (db, at), each range makes one
    function for each of its databases, and the few functions of a database are applied in order.
    """
    moves = F.create_map(*(F.lit(x) for (a, e), b in MOVES.items() for x in (f"{a}/{e}", b)))
    move = lambda s, e: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("/"), e)), s)
    ranged = durable(events.repartitionByRange("db", "at").withColumn("_range", F.spark_partition_id()))
    steps = F.array_sort(F.collect_list(F.struct("at", "event")))
    whole = F.aggregate(steps, F.array(*map(F.lit, NAMES)), lambda all_, x: F.transform(all_, lambda s: move(s, x["event"])))
    parts = ranged.groupBy("db", "_range").agg(whole.alias("to"))
    chain = F.array_sort(F.collect_list(F.struct("_range", "to")))
    last = F.aggregate(chain, F.lit(NAMES[0]), lambda s, part: F.element_at(part["to"], F.array_position(F.array(*map(F.lit, NAMES)), s).cast("int")))
    return parts.groupBy("db").agg(last.alias("state"))


def drained(slots: DataFrame, head: DataFrame, active: int) -> DataFrame:
    """whether a primary may step down: no active transaction, and no slot behind the head."""
    behind = F.count_if(F.col("log_seq") < F.col("head"))
    return slots.join(F.broadcast(head)).agg(((behind == 0) & F.lit(active == 0)).alias("drained"))


def fan_out(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """the log's rows under each local database that follows theirs; `mapping` (remote_db, local_db) has a row per followed database, and is broadcast if its size allows."""
    followed = mapping.select(F.col("remote_db").alias("_remote"), "local_db")
    return log.join(followed, F.col("db") == F.col("_remote")).drop("_remote")


def apply_snapshot(state: DataFrame, snapshot: DataFrame, tx: int, seq: int) -> DataFrame:
    """a follower's state after a snapshot: it replaces the old one, and its rows have the snapshot's numbers, so that later changes win and deleted keys are gone."""
    return snapshot.select("k", "v", F.lit(seq).cast("bigint").alias("seq"), F.lit(tx).cast("bigint").alias("tx"))
