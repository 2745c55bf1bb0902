"""Log files: scans, floors, retention, timelines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.plans.prefix import running
from changelake.schemas import UNBOUNDED


class LogUnavailable(ValueError):
    """The log does not reach back to the wanted operation."""


def scan_from(log: DataFrame, start: int, checked: bool = False) -> DataFrame:
    """The entries from operation `start` on; with `checked`, LogUnavailable if the log begins later."""
    if checked:
        first = log.agg(F.min("seq")).first()[0]
        if first is not None and start < first:
            raise LogUnavailable(f"the log begins at {first}")
    return log.where(F.col("seq") >= start)


def floor_lookup(log: DataFrame, target: int, location: str = "seq") -> DataFrame:
    """The location of the last entry up to `target`."""
    return log.where(F.col("seq") <= target).agg(F.max_by(location, "seq").alias("loc"))


def parsed_names(names: DataFrame) -> DataFrame:
    """Timeline and offset of log file names (name); files of the older form have timeline 0."""
    new = F.regexp_extract("name", r"^wal_(\d+)_(\d+)\.wal$", 1)
    old = F.regexp_extract("name", r"^(\d+)\.wal$", 1)
    offset = F.when(new != "", F.regexp_extract("name", r"^wal_(\d+)_(\d+)\.wal$", 2)).otherwise(old)
    return names.where((new != "") | (old != "")).select("name", F.when(new != "", new).otherwise("0").cast("bigint").alias("tli"), offset.cast("bigint").alias("start_offset"))


def files_of(log: DataFrame) -> DataFrame:
    """The files of a log with their first operations, as offsets too."""
    return log.groupBy("file_id").agg(F.min("seq").alias("first_op")).withColumn("tli", F.lit(0)).withColumn("start_offset", F.col("file_id"))


def purgeable(files: DataFrame, least: int) -> DataFrame:
    """The files that may go, in order: empty ones, and those whose successor begins at or before `least`; never the last one.

    The first file whose successor begins later ends the purge, and so does one before an empty last file, which bounds nothing. A file before another
    empty one stays, and the purge goes on. A file list has a row per file, so one window over it is small whatever the log.
    """
    order = Window.orderBy("tli", "start_offset")
    empty, after = F.col("first_op").isNull(), F.col("_next").isNull()
    marked = files.withColumns({"_next": F.lead("first_op").over(order), "_place": F.lead(F.lit(1)).over(order), "_second": F.lead(F.lit(1), 2).over(order)})
    stop = F.when(empty, False).when(after, F.col("_second").isNull()).otherwise(F.col("_next") > least)
    marked = marked.where("_place is not null").withColumn("_stop", stop).withColumn("_ok", empty | F.coalesce(F.col("_next") <= least, F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_ended", F.max("_stop").over(upto)).where("_ok and not _ended").select("file_id")


def retention_floor(slots: DataFrame, checkpoint: int | None, leader_safe: int | None) -> DataFrame:
    """The least of the last checkpoint, all slots and the leader's safe point; null stands for no constraint."""
    bound = lambda c: F.coalesce(c, F.lit(UNBOUNDED))
    own = [bound(F.lit(x).cast("bigint")) for x in (checkpoint, leader_safe)]
    return slots.agg(F.least(bound(F.min("log_seq")), *own).alias("safe"))


def prune_timelines(log: DataFrame, history: DataFrame) -> DataFrame:
    """The entries that are no part of an abandoned fork. A transaction counts whole, by its first operation: up to its timeline's end, or on a timeline without one.

    The history has a row per promotion; it is broadcast where its size allows.
    """
    ends = history.select(F.col("tli").alias("_tli"), F.col("end_op").alias("_end"))
    starts = log.groupBy(F.col("tli").alias("_of"), F.col("tx").alias("_tx")).agg(F.min("seq").alias("_start"))
    gone = starts.join(ends, F.col("_of") == F.col("_tli")).where(F.col("_start") > F.col("_end")).select("_of", "_tx")
    return log.join(gone, (F.col("tli") == F.col("_of")) & (F.col("tx") == F.col("_tx")), "left_anti")


def timeline_history(promotions: DataFrame) -> DataFrame:
    """(tli, start_op, end_op) from promotions (tli, end_op): each timeline starts where the one before ended. There is a row per promotion."""
    order = Window.orderBy("tli")
    return promotions.select("tli", F.lag("end_op", 1, 0).over(order).cast("bigint").alias("start_op"), "end_op")


def timeline_changes(changes: DataFrame, first: int = 1) -> DataFrame:
    """(tli, start_op, end_op) from changes (at, tli, last_op) of the current timeline, `first` at the start: a change without tli promotes to the next one.

    One to a higher timeline jumps there; the current one changes nothing, and an earlier one is refused, since timelines never rewind. There is a row per change.
    """
    steps = F.array_sort(F.collect_list(F.struct("at", F.col("tli").cast("bigint").alias("tli"), F.col("last_op").cast("bigint").alias("last_op"))))
    none = F.array().cast("array<struct<tli: bigint, start_op: bigint, end_op: bigint>>")
    start = F.struct(F.lit(first).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("end"), none.alias("past"))

    def step(s, x):
        to = F.coalesce(x["tli"], s["now"] + 1)
        moved = F.struct(to.alias("now"), x["last_op"].alias("end"), F.concat(s["past"], F.array(F.struct(s["now"].alias("tli"), s["end"].alias("start_op"), x["last_op"].alias("end_op")))).alias("past"))
        return F.when(to > s["now"], moved).otherwise(s)

    return changes.agg(F.aggregate(steps, start, step).alias("s")).select(F.inline("s.past"))


def chunked(state: DataFrame, size: int, order: str = "k") -> DataFrame:
    """Chunks of a snapshot of about `size` bytes of keys and values, by running size in key order. A null value has no bytes."""
    own = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    sized = state.select(order, own.cast("bigint").alias("_size"))
    summed = running(sized, [order], "_size", "_upto")
    return summed.select(order, F.floor((F.col("_upto") - F.col("_size")) / size).cast("bigint").alias("chunk"))


#: Bytes of an entry in a packet besides key and value, of a packet at most, and of a transaction that a follower may hold.
ENTRY, PACKET, BUFFER = 25, 1 << 20, 64 << 20


def packed(log: DataFrame, most: int = PACKET) -> DataFrame:
    """(seq, tx, marker, size, packet): each transaction's entries and its commit marker after them, in packets of about `most` bytes by running size.

    A packet may end within a transaction, whose marker then comes in a later one.
    """
    size = F.lit(ENTRY) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    entries = log.select("seq", "tx", F.lit(False).alias("marker"), size.cast("bigint").alias("size"))
    markers = log.groupBy("tx").agg(F.max("seq").alias("seq")).select("seq", "tx", F.lit(True).alias("marker"), F.lit(ENTRY).cast("bigint").alias("size"))
    summed = running(entries.unionByName(markers), ["seq", "marker"], "size", "_upto")
    return summed.select("seq", "tx", "marker", "size", F.floor((F.col("_upto") - F.col("size")) / most).cast("bigint").alias("packet"))


def overflowing(packets: DataFrame, most: int = BUFFER) -> DataFrame:
    """(tx, bytes) of the transactions that are too large for a follower, which holds entries until their marker."""
    return packets.where("not marker").groupBy("tx").agg(F.sum("size").cast("bigint").alias("bytes")).where(F.col("bytes") > most)


def committed_only(packets: DataFrame) -> DataFrame:
    """Rows of packets (tx, marker) whose transaction's commit marker has arrived, without the markers."""
    done = packets.groupBy("tx").agg(F.max("marker").alias("_done")).where("_done").select("tx")
    return packets.where("not marker").join(done, "tx", "left_semi")
