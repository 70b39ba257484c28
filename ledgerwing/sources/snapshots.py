"""Versioned snapshots of file trees: each version reads only the files that changed since the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions.labels import change_category
from ledgerwing.operators.pairs import diff_snapshots
from ledgerwing.sources.readers import below, kept_folders

#: Changed files that are named to one read; more are read in several.
READ_AT_ONCE = 10_000
ENTRY = "path string, content_hash string, size long, modified timestamp, category string, hashed boolean"


class SnapshotStore:
    """Snapshots below a folder, a version each: path, content_hash, size, modified, category, hashed (read for this version)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the versions that were written whole, in order."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = files.globStatus(jvm.org.apache.hadoop.fs.Path(self.folder + "/v*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in done or [])

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/v{version}")

    def take(self, root: str, suffixes: tuple[str, ...] = ()) -> int:
        """Write a new version of the files below root, hidden ones and skipped folders left out; its number.

        suffixes: endings of the names that count, all if there are none. A file of the same path, size and time as in
        the last version keeps its hash unread. Sizes and times come from the listing; contents are read for the others alone.
        """
        last = max(self.versions(), default=0)
        folders = kept_folders(self.spark, root, max_depth=None)
        path = below(root, F.col("path"))
        name = F.element_at(F.split(path, "/"), -1)
        wanted = ~name.startswith(".")
        if suffixes:
            ends = F.lit(False)
            for suffix in suffixes:
                ends = ends | name.endswith(suffix)
            wanted = wanted & ends
        listed = self._files(folders).filter(wanted).select(F.col("path").alias("full"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        before = self.load(last).select("path", "size", "modified", "content_hash") if last else None
        if before is None:
            hashes = self._files(folders).filter(wanted).select(F.col("path").alias("full"), F.sha2("content", 256).alias("content_hash"))
            out = listed.join(hashes, "full").withColumn("hashed", F.lit(True))
        else:
            kept = listed.join(before, ["path", "size", "modified"], "left")
            changed = kept.filter("content_hash is null").select("full")
            fresh = self._hashes(changed)
            out = kept.join(fresh, "full", "left").withColumn("hashed", F.col("content_hash").isNull())
            out = out.withColumn("content_hash", F.coalesce("content_hash", "fresh_hash"))
        out = out.withColumn("category", change_category(F.col("path")))
        out.select("path", "content_hash", "size", "modified", "category", "hashed").write.parquet(f"{self.folder}/v{last + 1}")
        return last + 1

    def diff(self, before: int, after: int) -> DataFrame:
        """What was added, removed and modified between two versions."""
        return diff_snapshots(self.load(before), self.load(after))

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.format("binaryFile").load(paths)

    def _hashes(self, changed: DataFrame) -> DataFrame:
        """full, fresh_hash of the named files, READ_AT_ONCE of them a read."""
        reads = -(-changed.count() // READ_AT_ONCE)
        out = self.spark.createDataFrame([], "full string, fresh_hash string")
        for n in range(reads):
            own = [r["full"] for r in changed.filter(F.pmod(F.xxhash64("full"), F.lit(reads)) == n).collect()]  # bounded by READ_AT_ONCE
            if own:
                out = out.unionByName(self._files(own).select(F.col("path").alias("full"), F.sha2("content", 256).alias("fresh_hash")))
        return out
