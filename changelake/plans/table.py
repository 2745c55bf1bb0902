"""A versioned Parquet table: writes and appends make new versions, each with a manifest of its own that says what it consists of."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelake.sources import files


class VersionedTable:
    """Folders of rows, and manifest-<version>.json files that list those of a version. The highest whole manifest counts, so there is never a moment without one.

    A key's row is the one of the highest `order`: by default the latest append, or a column of the rows, such as a sequence number. A row that is `_gone`
    deletes its key. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, order: str = "_part"):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order
        self.stored = f"{schema}, _part bigint, _gone boolean"

    def manifest(self, version: int | None = None) -> dict:
        """The description of a version, the current one unless told; version 0 is the empty table. A manifest that was cut off while it was written is none."""
        names = [n for n in files.names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        for name in sorted(names, reverse=True):
            try:
                found = json.loads(files.read_text(self.spark, f"{self.path}/{name}"))
            except ValueError:
                continue
            if version is None or found["version"] == version:
                return found
        return {"version": 0, "parts": [], "files": []}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current or an older version: one for each key that is there."""
        parts = self.manifest(version)["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{p}" for p in parts))
        if len(parts) > 1 or self.order != "_part":
            nth = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(self.order), F.desc("_part")))
            rows = rows.withColumn("_nth", nth).where("_nth = 1")
        return rows.where("not _gone").drop("_part", "_gone", "_nth")

    def processed(self) -> DataFrame:
        """(filename) of the files whose rows are in the table."""
        found = self.manifest()["files"]
        if not found:
            return self.spark.createDataFrame([], "filename string")
        return self.spark.read.schema("filename string").parquet(*(f"{self.path}/{p}" for p in found))

    def _publish(self, rows: DataFrame, parts: list[str], done: list[str], names: DataFrame | None, keep: int, facts: dict) -> int:
        version = self.manifest()["version"] + 1
        gone = F.col("_gone") if "_gone" in rows.columns else F.lit(False)
        rows = rows.withColumns({"_part": F.lit(version).cast("bigint"), "_gone": gone})
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        if names is not None:
            names.select("filename").write.mode("overwrite").parquet(f"{self.path}/files-v{version}")
            done = [*done, f"files-v{version}"]
        found = {"version": version, "parts": [*parts, f"v{version}"], "files": done, **facts}
        files.write_text(self.spark, f"{self.path}/manifest-{version:012d}.json", json.dumps(found))
        self._clean(version, keep)
        return version

    def _clean(self, version: int, keep: int) -> None:
        """Manifests of all but the last `keep` versions go, and folders that no manifest lists any more."""
        names = files.names(self.spark, self.path)
        used: set[str] = set()
        for name in sorted(n for n in names if n.startswith("manifest-")):
            number = name.removeprefix("manifest-").removesuffix(".json")
            if number.isdigit() and int(number) <= version - keep:
                files.delete(self.spark, f"{self.path}/{name}")
            elif number.isdigit():
                found = self.manifest(int(number))
                used |= {*found["parts"], *found["files"]}
        for name in names:
            if name.startswith(("v", "files-v")) and name not in used:
                files.delete(self.spark, f"{self.path}/{name}")

    def write(self, state: DataFrame, keep: int = 2, names: DataFrame | None = None, **facts) -> int:
        """Make `state` the current version, described by `facts`. A run that fails before its manifest is there leaves the table as it was."""
        return self._publish(state, [], self.manifest()["files"], names, keep, facts)

    def append(self, rows: DataFrame, keep: int = 2, names: DataFrame | None = None, **facts) -> int:
        """Add rows, with `_gone` for keys to delete, and the (filename) of the files that they are from. What is there is not written again."""
        before = self.manifest()
        return self._publish(rows, before["parts"], before["files"], names, keep, facts)

    def vacuum(self, size_mb: int = 128) -> int:
        """The current version as one part of fewer, larger files, with the table's statistics: its rows, bytes, and lowest and highest key."""
        parts = self.manifest()["parts"]
        state, done = self.read(), self.processed()
        lengths = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{self.path}/{p}" for p in parts]) if parts else None
        total = lengths.agg(F.sum("length")).first()[0] if parts else 0
        row = state.agg(F.count("*").alias("rows"), F.min("k").alias("lowest"), F.max("k").alias("highest")).first()
        facts = {"statistics": {**row.asDict(), "bytes": int(total or 0)}}
        return self._publish(state.repartition(max(1, int(total or 0) // (size_mb << 20)), "k"), [], [], done.coalesce(1) if parts else None, 2, facts)
