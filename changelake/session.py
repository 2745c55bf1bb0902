"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What the engine relies on. Sizes of partitions are left to adaptive execution and to the cluster's own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; names in `more` have underscores for dots."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names. Only a local session without that setting, as in tests, gets a folder of its machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint(eager=True)
