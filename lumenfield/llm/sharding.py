"""Size-tiered compaction of an append-only table of immutable Parquet shards, in DataFrame operations only.

A shard is one Parquet file.  Appends write small shards; a compaction takes a tier (shards of similar size) that has
grown to ``fan_in`` members and rewrites it into files of about the target size; no file is ever changed.  Each version is a
small table of what it adds and removes; the shards alive at a version follow from those up to it, by a join.  A version is
written aside by Spark and then renamed into place by a call that fails if that version exists, so a reader sees a whole
version or none, and of two writers one has to start again from the newer version.  Files that no version names yet are never
read, hence a job that is lost halfway leaves only garbage for ``vacuum``.  The driver sees counts by tier, and the paths of
what it is about to read, as the file index of any scan does; a merge takes at most ``MERGE_SHARDS``.

Defined results: any columns, nulls included, are kept as they are; an empty append commits a version without new
shards; repeated rows are kept; reading a table without shards gives an empty table of the given schema.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 64 << 10
FAN_IN = 4

MERGE_SHARDS = 20_000

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())])


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class ShardTable:
    spark: SparkSession
    root: str
    schema: T.StructType
    target_bytes: int = TARGET_BYTES
    fan_in: int = FAN_IN

    # --- the shared store ---------------------------------------------------------------------------------------------

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration(), jvm

    def _path(self, path: str):
        return self._hadoop()[0].Path(path)

    def _fs(self):
        fs, conf, _ = self._hadoop()
        return fs.Path(self.root).getFileSystem(conf)

    def _commit(self, staged: str, version: int) -> None:
        fs, conf, jvm = self._hadoop()
        target = self._path(self._version(version))
        self._fs().mkdirs(target.getParent())
        kind = getattr(fs, "Options$Rename")
        context = fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
        try:
            context.rename(self._path(staged), target, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise CommitConflict(f"version {version} of {self.root} exists") from e
            raise

    def _version(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:012d}"

    # --- versions -----------------------------------------------------------------------------------------------------

    def latest(self) -> int:
        """The number of the newest version, 0 for none."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return 0
        return max([0, *(int(s.getPath().getName()[1:]) for s in self._fs().listStatus(folder))])

    def log(self) -> DataFrame:
        """What all versions have added and removed."""
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v*") if self.latest() else self.spark.createDataFrame([], MANIFEST)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards alive at a version."""
        log = self.log() if version is None else self.log().where(F.col("version") <= version)
        return log.where("not gone").join(log.where("gone").select("path"), "path", "left_anti").drop("gone")

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self.manifest(version))

    def _scan(self, shards: DataFrame) -> DataFrame:
        paths = [r["path"] for r in shards.select("path").collect()]  # one short row for each file, as a scan lists them anyway
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in a folder; only Parquet footers are read."""
        files = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        steps = F.floor(F.log(F.col("bytes") / SMALLEST_BYTES) / math.log(self.fan_in)).cast("int")
        tier = F.when(F.col("bytes") <= SMALLEST_BYTES, 0).otherwise(steps + 1)
        return files.select("path", "bytes", "rows", tier.alias("tier"), F.lit(False).alias("gone"), F.lit(version).cast("bigint").alias("version"))

    def _publish(self, rows: DataFrame, version: int) -> int:
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.coalesce(8).write.json(staged)
        self._commit(staged, version)
        return version

    # --- writers ------------------------------------------------------------------------------------------------------

    def _fresh(self) -> str:
        return f"{self.root}/shards/{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> int:
        """Commit ``rows`` as new shards, one for each partition that has any; the new version."""
        folder = self._fresh()
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
        return self.append_written(folder)

    def append_written(self, folder: str) -> int:
        """Commit the Parquet files of a folder under ``shards``; the new version."""
        version = self.latest() + 1
        return self._publish(self._written(folder, version), version)

    def _small(self) -> DataFrame:
        return self.manifest().where(F.col("bytes") < self.target_bytes // 2)

    def full_tiers(self) -> list[tuple[int, int]]:
        """Tiers below the target size with ``fan_in`` shards or more, the smallest first, and their bytes."""
        tiers = self._small().groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
        return sorted((r["tier"], r["b"]) for r in tiers if r["n"] >= self.fan_in and r["n"] > self._files(r["b"]))

    def _files(self, size: int) -> int:
        return max(1, round(size / self.target_bytes))

    def compact(self) -> int:
        """Merge until no tier is full; the number of merges."""
        merges = 0
        while tiers := self.full_tiers():
            version, (tier, size) = self.latest() + 1, tiers[0]
            runs = self._small().where(F.col("tier") == tier).orderBy("path").limit(MERGE_SHARDS)
            folder = self._fresh()
            self._scan(runs).coalesce(self._files(size)).write.option("compression", "zstd").parquet(folder)
            removed = runs.select("path", "bytes", "rows", "tier", F.lit(True).alias("gone"), F.lit(version).cast("bigint").alias("version"))
            self._publish(self._written(folder, version).unionByName(removed), version)
            merges += 1
        return merges

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete the shards that none of the newest versions name, and what lost writers have left; how many went.  Readers
        of older versions and writers at work must have ended."""
        fs, first = self._fs(), max(1, self.latest() - keep_versions + 1)
        gone = 0
        for row in self.log().where(F.col("gone") & (F.col("version") <= first)).select("path").toLocalIterator():
            gone += bool(fs.delete(self._path(row["path"]), False))
        folder = F.regexp_extract("path", "/shards/([^/]+)/", 1)
        named = {r["f"] for r in self.log().select(folder.alias("f")).distinct().collect()}  # one for each append or merge
        shards = self._path(f"{self.root}/shards")
        for status in fs.listStatus(shards) if fs.exists(shards) else ():
            if status.getPath().getName() not in named:
                gone += bool(fs.delete(status.getPath(), True))
        return gone


def load_in_arrivals(docs: DataFrame, root: str, *, arrivals: int = 4, key: str = "doc_id", target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardTable:
    """``docs`` in ``arrivals`` parts by a hash of ``key``, written in one scan and then committed one by one, with a
    compaction after each.  The last two versions stay readable."""
    table = ShardTable(docs.sparkSession, root, docs.schema, target_bytes, fan_in)
    part, folder = free_name(docs, "arrival"), f"{root}/shards/{uuid.uuid4().hex}"
    dealt = docs.withColumn(part, F.coalesce(F.pmod(F.xxhash64(key), F.lit(arrivals)), F.lit(0)).cast("int"))
    dealt.write.option("compression", "zstd").partitionBy(part).parquet(folder)
    for k in range(arrivals):
        arrived = f"{folder}/{part}={k}"
        if table._fs().exists(table._path(arrived)):
            table.append_written(arrived)
            table.compact()
    table.vacuum()
    return table
