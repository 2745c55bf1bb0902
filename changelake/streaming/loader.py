"""Streams of change files into state tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from changelake.operators.merge import fold_into, ungated
from changelake.plans.table import VersionedTable


def _new(table: VersionedTable, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the files that the table does not have yet, and these files' names. A batch has few files: the stream's maxFilesPerTrigger."""
    names = ungated(batch.select(F.col("file").alias("filename")).distinct(), table.processed())
    return batch.join(F.broadcast(names.withColumnRenamed("filename", "file")), "file", "left_semi"), names


def _loader(table: VersionedTable, rows_of: Callable[[DataFrame], DataFrame], vacuum_every: int):
    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            new, names = _new(table, batch)
            count = names.count()
            if not count:
                return  # a restart, or a new checkpoint, repeats files that are in the table
            since = table.manifest().get("files_since_vacuum", 0) + count
            table.append(rows_of(new), names=names, files_since_vacuum=since)
            if since >= vacuum_every:
                table.vacuum()
        finally:
            batch.unpersist()

    return run


def into_tombstones(table: VersionedTable, vacuum_every: int = 50):
    """B05 with C04: a batch function that appends the rows of new files; the highest version of each key counts, tombstones included, so the order of files does not matter."""

    def rows_of(batch: DataFrame) -> DataFrame:
        return batch.where("k is not null").select("k", "v", F.col("seq").alias("log_seq"), F.col("tx").alias("tx_id"), F.timestamp_millis("ts").alias("updated_at"), F.coalesce("del", F.lit(False)).alias("is_deleted"))

    return _loader(table, rows_of, vacuum_every)


def into_hard_deletes(table: VersionedTable, vacuum_every: int = 50):
    """B04 with C02 and C03: a batch function that folds the new files into the table by name, as an older put in a later file may bring a deleted key back.

    Only the batch's keys are read of the table, and what has become of them is appended.
    """
    return _loader(table, lambda batch: fold_into(table.read(), batch), vacuum_every)


def start(changes: DataFrame, table: VersionedTable, checkpoint: str, hard_delete: bool = False, once: bool = True, vacuum_every: int = 50) -> StreamingQuery:
    """Run a stream of changes into a table; with `once`, over what is there and then end. The table knows its files by name, so restarts and new checkpoints are exact.

    Every `vacuum_every` files the table is rewritten in larger files, with statistics (B07).
    """
    run = into_hard_deletes(table, vacuum_every) if hard_delete else into_tombstones(table, vacuum_every)
    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()


def resume_state(changes: DataFrame, by: str = "file") -> DataFrame:
    """(by, last_seq, updated): up to where the changes of each file, or database, were written, and when."""
    return changes.groupBy(by).agg(F.max("seq").alias("last_seq"), F.max("ts").alias("updated"))


def rotations(events: DataFrame, most_bytes: int, most_seconds: int, idle_seconds: int) -> DataFrame:
    """B02 as a query: (db, at, number): the file number of each change (db, at, size) by a database's order of arrival, where a file ends when it is too large, too old or idle.

    Whether a file ends depends on where it began, so each database has one writer: its changes stream through one task, which holds four numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, number, since, last, size = object(), 0, 0, 0, 0
        for batch in batches:
            out = []
            for own, at, more in zip(*(batch.column(c).to_pylist() for c in ("db", "micros", "size")), strict=True):
                if own != db:
                    db, number, since, last, size = own, 0, at, at, 0
                if size > most_bytes or at - since > most_seconds * 1_000_000 or at - last > idle_seconds * 1_000_000:
                    number, since, size = number + 1, at, 0
                last, size = at, size + more
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("db"), batch.column("at"), pa.array(out, pa.int32())], names=["db", "at", "number"])

    rows = events.select("db", "at", F.unix_micros("at").alias("micros"), F.col("size").cast("bigint").alias("size"))
    kind = events.schema["db"].dataType.simpleString()
    return rows.repartition("db").sortWithinPartitions("db", "at", "size").mapInArrow(run, f"db {kind}, at timestamp, number int")
