"""Change records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.functions.codec import value_text
from changelake.schemas import CDC
from changelake.sources import files

GLOB = "cdc-*.jsonl"
#: Longest line that is read; a longer one counts as bad.
LONGEST = 1 << 20


def decoded(lines: DataFrame) -> DataFrame:
    """The records of `lines` (value and any other columns) with CDC's columns, and `bad` for lines that are no record with a key.

    v is the JSON text of the value: numbers, objects and strings as they are written, strings with their quotes; null if it is missing or null.
    """
    record = F.from_json("value", CDC)
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json("value"), "$.v", "variant"))
    v = F.when(kind == "STRING", F.to_json(F.variant_get(F.try_parse_json("value"), "$.v", "variant"))).otherwise(F.col("_r.v"))
    others = [c for c in lines.columns if c != "value"]
    whole = (F.length("value") <= LONGEST) & F.try_parse_json("value").isNotNull()
    found = lines.where(F.trim("value") != "").withColumn("_r", record)
    return found.select(
        *others, "_r.k", v.alias("v"), F.coalesce("_r.del", F.lit(False)).alias("del"), "_r.seq", "_r.tx", "_r.ts", (~F.coalesce(whole, F.lit(False)) | F.col("_r.k").isNull() | F.col("_r.seq").isNull()).alias("bad")
    )


def _named(lines: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_name")
    return lines.select("value", name.alias("file"), F.regexp_extract(name, r"^cdc-(.+)-\d+-\d+\.jsonl$", 1).alias("db"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All finished change files of a folder, with file name and database; bad lines are left out."""
    return decoded(_named(spark.read.option("pathGlobFilter", GLOB).text(folder))).where("not bad").drop("bad")


def dropped(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each file are bad."""
    return decoded(_named(spark.read.option("pathGlobFilter", GLOB).text(folder))).groupBy("file").agg(F.count_if("bad").alias("dropped"))


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The same, as an unbounded table of files that appear. Its checkpoint remembers which files were read."""
    lines = spark.readStream.option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return decoded(_named(lines)).where("not bad").drop("bad")


def encoded(log: DataFrame, form: str = "json") -> DataFrame:
    """One JSON line per change (k, v, del, seq, tx, ts in milliseconds); deletes have no value, and v and del are left out where they say nothing."""
    gone = F.coalesce(F.col("del"), F.lit(False))
    if form == "json":
        value = value_text(F.col("v"), "json")
    else:
        value = F.get(F.regexp_extract_all(F.to_json(F.array(value_text(F.col("v"), form))), F.lit(r"(?s)^\[(.*)\]$"), F.lit(1)), F.lit(0))
    part = lambda name, x: F.concat(F.lit(f',"{name}":'), x)
    head = F.get(F.regexp_extract_all(F.to_json(F.struct("k")), F.lit(r"(?s)^(.*)\}$"), F.lit(1)), F.lit(0))
    body = F.concat(head, F.when(~gone & F.col("v").isNotNull(), part("v", value)).otherwise(""), F.when(gone, part("del", F.lit("true"))).otherwise(""), part("seq", F.col("seq").cast("string")), part("tx", F.col("tx").cast("string")), part("ts", F.col("ts").cast("string")), F.lit("}"))
    return log.select(body.alias("value"))


def write(log: DataFrame, folder: str, db: str, stamp: int, records_per_file: int = 500_000, form: str = "json") -> list[str]:
    """Write changes as files cdc-<db>-<stamp>-<number>.jsonl, in ranges of seq. Spark commits them in a side folder, and renaming publishes each whole."""
    spark, side = log.sparkSession, f"{folder}/.{db}-{stamp}.part"
    ranged = log.repartitionByRange("seq").sortWithinPartitions("seq")
    encoded(ranged, form).write.option("maxRecordsPerFile", records_per_file).text(side)
    out = []
    for number, name in enumerate(n for n in files.names(spark, side) if n.startswith("part-")):
        out.append(f"cdc-{db}-{stamp}-{number:08d}.jsonl")
        files.rename(spark, f"{side}/{name}", f"{folder}/{out[-1]}")
    files.delete(spark, side)
    return out
