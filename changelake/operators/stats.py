"""Statistics and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.operators.gc import record_size

#: Bytes of a log frame besides its entries, and of an entry besides key and value.
FRAME, WAL_ENTRY = 28, 9
#: The series of collector(): those of the server, and those of each database.
SERVER_SERIES = ("connections_active", "connections_accepted_total", "transactions_active")
DB_SERIES = ("connections", "active_txs", "conflicts_total", "offset", "replica_lag", "wal_files", "wal_bytes", "vlog_files", "vlog_bytes", "key_count")


def duration_text(seconds: int) -> str:
    """Seconds as hours, minutes and seconds, larger units only where there are any: 1h2m3s."""
    hours, minutes, rest = seconds // 3600, seconds // 60 % 60, seconds % 60
    return f"{hours}h{minutes}m{rest}s" if hours else f"{minutes}m{rest}s" if minutes else f"{rest}s"


def _measured(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Live keys, replaced bytes, files and the head, by one window over the versions of each key and one aggregate."""
    order = Window.partitionBy(*by, "k").orderBy("seq")
    rows = log.select(*by, "k", "seq", "file_id", F.coalesce("del", F.lit(False)).alias("del"), record_size().alias("size"))
    rows = rows.withColumns({"_later": F.lead("seq").over(order), "_old": F.lag("size").over(order)})
    live = F.count_if(F.col("_later").isNull() & ~F.col("del"))
    return rows.groupBy(*by).agg(
        live.alias("key_count"), F.coalesce(F.sum("_old"), F.lit(0)).cast("bigint").alias("garbage_bytes"), F.count_distinct("file_id").alias("vlog_files"), F.sum("size").cast("bigint").alias("vlog_bytes"),
        F.max("seq").alias("head"),
    )


def stat(log: DataFrame, slots: DataFrame, wal_files: int, state: str, conflicts: int = 0, connections: int = 0, active_txs: int = 0, uptime: int = 0, min_replicas: int = 0) -> DataFrame:
    """One row of a database's eleven statistics, from its log, its slots (log_seq) and what its server counts."""
    lag = slots.agg(F.min("log_seq").alias("_least"))
    found = _measured(log).crossJoin(F.broadcast(lag))
    fixed = lambda x: F.lit(x).cast("bigint")
    return found.select(
        F.lit(state).alias("state"), "key_count", "garbage_bytes", fixed(conflicts).alias("conflicts"), fixed(connections).alias("active_connections"), "vlog_files", fixed(wal_files).alias("wal_files"),
        fixed(active_txs).alias("active_txs"), F.coalesce(F.greatest(F.col("head") - F.col("_least"), F.lit(0)), F.lit(0)).cast("bigint").alias("replica_lag"), F.lit(duration_text(uptime)).alias("uptime"), fixed(min_replicas).alias("min_replicas"),
    )


def stat_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct("*")).alias("stat"))


def collector(log: DataFrame, slots: DataFrame, sessions: DataFrame, transactions: DataFrame) -> DataFrame:
    """(metric, db, value) of thirteen series, the server's with a null db, from the log (db, file_id, wal_id and its columns), slots (db, log_seq), sessions (db, open) and transactions (db, active, conflict)."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0)) + WAL_ENTRY
    wal = log.groupBy("db").agg(F.count_distinct("wal_id").alias("wal_files"), (F.sum(size) + FRAME * F.count_distinct("tx")).cast("bigint").alias("wal_bytes"))
    own = _measured(log, ("db",)).drop("garbage_bytes").withColumnRenamed("head", "offset").join(wal, "db")
    least = slots.groupBy("db").agg(F.min("log_seq").alias("_least"))
    open_ = sessions.groupBy("db").agg(F.count_if("open").alias("connections"))
    running = transactions.groupBy("db").agg(F.count_if("active").alias("active_txs"), F.count_if("conflict").alias("conflicts_total"))
    # A row per database on every side.
    joined = own.join(least, "db", "left").join(open_, "db", "left").join(running, "db", "left")
    joined = joined.withColumn("replica_lag", F.greatest(F.col("offset") - F.col("_least"), F.lit(0)))
    by_db = joined.select(F.col("db").cast("string").alias("db"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in DB_SERIES))
    server = sessions.agg(F.count_if("open").alias("connections_active"), F.count("*").alias("connections_accepted_total")).crossJoin(transactions.agg(F.count_if("active").alias("transactions_active")))
    server = server.select(F.lit(None).cast("string").alias("db"), *(F.col(c).cast("bigint").alias(c) for c in SERVER_SERIES))
    return server.unpivot(["db"], list(SERVER_SERIES), "metric", "value").unionByName(by_db.unpivot(["db"], list(DB_SERIES), "metric", "value"))


def cdc_metrics(changes: DataFrame) -> DataFrame:
    """(metric, value): the last sequence number that was written."""
    return changes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("value")).select(F.lit("last_seq").alias("metric"), "value")


def loader_counts(batch: DataFrame) -> DataFrame:
    """Rows by what they do, and rows that are dropped for want of a key."""
    kind = F.when(F.col("k").isNull(), "dropped").when(F.coalesce("del", F.lit(False)), "delete").otherwise("upsert")
    return batch.groupBy(kind.alias("type")).agg(F.count("*").alias("rows"))


def storage_stats(paths: DataFrame) -> DataFrame:
    """Files and bytes by suffix, from (path, length)."""
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return paths.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))
