"""Deterministic workloads and their expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Device kinds, and shares of states in percent.
KINDS = ("sensor", "gateway", "camera", "thermostat", "tracker")
INSTALLED = (("pending", 10), ("installing", 10), ("failed", 10), ("installed", 70))


def _share(x, table):
    """The label of a number from 0 to 99 under shares in percent."""
    out, upto = None, 0
    for label, percent in table:
        upto += percent
        out = F.when(x < upto, label) if out is None else out.when(x < upto, label)
    return out


def bench_keys(spark: SparkSession, clients: int, each: int, width: int = 32, prefix: str = "bench") -> DataFrame:
    """(client, idx, k): keys of a benchmark, padded to `width`."""
    n = spark.range(clients * each)
    client, idx = F.floor(F.col("id") / each).cast("bigint"), F.col("id") % each
    return n.select(client.alias("client"), idx.alias("idx"), F.rpad(F.concat_ws("-", F.lit(prefix), client, idx), width, "x").alias("k"))


def device_uuid(x):
    """A device's identifier from a linear congruential seed."""
    h = F.md5((x * 1664525 + 1013904223).cast("string"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def devices(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(device_id, k, v): JSON values of n devices."""
    dice = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (dice(1, 5) + 1).cast("int"))
    value = F.struct(F.concat(F.lit("device-"), F.col("id")).alias("device_id"), kind.alias("device_type"), dice(2, 151).alias("number_of_apps_installed"), (dice(3, 100) < 80).alias("is_active"), F.struct((dice(4, 18001) / 100 - 90).alias("lat"), (dice(5, 36001) / 100 - 180).alias("lon")).alias("gps_coords"))
    return spark.range(n).select(F.col("id").alias("device_id"), F.concat(F.lit("device-"), F.col("id")).alias("k"), F.to_json(value).alias("v"))


def applications(devices_: DataFrame, most: int = 150, seed: int = 42) -> DataFrame:
    """(device_uuid, app_uuid, status, installed_status): 1 to `most` applications of each device (device_id)."""
    count = F.pmod(F.xxhash64("device_id", F.lit(seed)), F.lit(most)) + 1
    each = devices_.select("device_id", F.explode(F.sequence(F.lit(1).cast("bigint"), count)).alias("n"))
    identity = F.col("device_id") * 1_000_000 + F.col("n")
    dice = lambda salt: F.pmod(F.xxhash64("device_id", "n", F.lit(salt)), F.lit(100))
    return each.select(device_uuid(F.col("device_id")).alias("device_uuid"), device_uuid(identity).alias("app_uuid"), F.when(dice(1) < 80, "Managed").otherwise("Unmanaged").alias("status"), _share(dice(2), INSTALLED).alias("installed_status"))


def list_diff(current: DataFrame, target: DataFrame, key: str = "c", item: str = "p") -> DataFrame:
    """Per key, how many items stay, come and go between two lists of (key, item) pairs."""
    a, b = current.select(key, item, F.lit(1).alias("_a")).distinct(), target.select(key, item, F.lit(1).alias("_b")).distinct()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    both = a.join(b, [key, item], "full_outer")
    return both.groupBy(key).agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("upd"), n(F.col("_a").isNull()).alias("ad"), n(F.col("_b").isNull()).alias("rem"))


def list_diff_arrays(lists: DataFrame) -> DataFrame:
    """H01 on arrays `current` and `target`."""
    return lists.withColumns({"to_update": F.array_intersect("current", "target"), "to_add": F.array_except("target", "current"), "to_remove": F.array_except("current", "target")})


def shards(n: int, workers: int) -> list[tuple[int, int]]:
    """The first and last key of each worker's range; the last takes the rest."""
    size = n // workers
    return [(i * size + 1, n if i == workers - 1 else (i + 1) * size) for i in range(workers)]


def transfers_balance(transfers: DataFrame, accounts: int, opening: int) -> DataFrame:
    """Balances of accounts 0 to n-1 after committed transfers (src, dst, amount)."""
    moves = transfers.select(F.col("src").alias("account"), (-F.col("amount")).alias("d")).unionByName(transfers.select(F.col("dst").alias("account"), F.col("amount").alias("d")))
    total = moves.groupBy("account").agg(F.sum("d").alias("d"))
    return transfers.sparkSession.range(accounts).withColumnRenamed("id", "account").join(total, "account", "left").select("account", (F.lit(opening) + F.coalesce("d", F.lit(0))).cast("bigint").alias("balance"))


def phase_stats(operations: DataFrame) -> DataFrame:
    """Operations per second and mean milliseconds of each phase, from (phase, started, ended, ok)."""
    seconds = F.max(F.col("ended").cast("double")) - F.min(F.col("started").cast("double"))
    ok = F.count_if("ok")
    return operations.groupBy("phase").agg(ok.alias("ok"), (ok / seconds).alias("tps"), (seconds * 1000 / ok).alias("amortized_ms"))


def counters(log: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters after increments (k): the latest value of each key plus how often it was raised."""
    latest = log.groupBy("k").agg(F.max_by(F.when(~F.col("del"), F.get_json_object("v", "$.k").cast("bigint")), "seq").alias("n"))
    raised = increments.groupBy("k").agg(F.count("*").alias("m"))
    return latest.join(raised, "k", "full_outer").select("k", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("bigint").alias("value"))
