"""A shard store with size-tiered compaction, in DataFrame operations.

Arrivals are appended as small immutable Parquet shards. Compaction puts shards of similar size in tiers (powers of
``fanout`` below half the target size) and merges a tier that has ``fanout`` shards or more into files of about the target
size; it repeats until no tier is full. A merge reads whole shards and puts them together in coalesced partitions:
nothing is shuffled, and no task holds more than its output file's rows, one batch at a time.

The manifest of a version is a Parquet table with a row for each live shard: its folder, file, bytes, rows, level, the
version that added it and its columns. A version exists from the moment its pointer file, written aside, is renamed to
``versions/<number>``; renaming never overwrites, so of two writers that build on one version one fails and nothing is
half visible. A version can be read for a grace period after the next one was made, and its shards stay as long:
``vacuum`` first drops the pointers of versions that are out of it, then the shards and manifests that none of the others lists.
It leaves alone whatever is younger than the grace period itself, as a writer that has not committed yet owns files that
no version lists. A job that dies, or an executor that is lost, leaves files that no version lists either.

Rows come back as they were put in: nulls, empty texts, repeated rows and any columns. An arrival may have columns that
earlier ones lack, or lack some; rows without a column have null there. A column of another type than before is refused
when it is appended. An empty arrival adds no shard.

The driver sees a row for each folder of live shards (one for each append or merge), not one for each shard: a folder of
which all shards are live is read by its name, and only of others are the files named.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from waygrid.llm.shared import whole_row

_TYPES = {"level": T.IntegerType()} | dict.fromkeys(("folder", "file", "columns"), T.StringType())
MANIFEST = T.StructType([T.StructField(c, _TYPES.get(c, T.LongType())) for c in ("folder", "file", "bytes", "rows", "level", "added", "written", "columns")])


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    fanout: int = 4  # shards that fill a tier, and the ratio of sizes between tiers
    most_shards: int = 10_000  # shards that one merge takes; a fuller tier is merged in several
    grace_s: int = 86_400  # vacuum leaves younger files alone


def _together(schemas: list[str]) -> T.StructType:
    """All columns of several schemas, in the order of their first mention; of one name and two types: an error."""
    found: dict[str, T.StructField] = {}
    for text in schemas:
        for f in T.StructType.fromJson(json.loads(text)).fields:
            if f.name in found and found[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} has the types {found[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
            found.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(found.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest version; 0 before the first append."""
        folder = self._path("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([0, *map(int, filter(str.isdigit, names))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST])
        name = self.spark.read.text(f"{self.root}/versions/{version:08d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def schema(self, manifest: DataFrame) -> T.StructType:
        """The columns of all shards; as many rows come to the driver as there are different schemas."""
        rows = manifest.groupBy("columns").agg(F.min("added").alias("since")).orderBy("since", "columns").collect()
        return _together([r["columns"] for r in rows])

    def _commit(self, manifest: DataFrame, base: int) -> int:
        name = uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        self.spark.range(1).select(F.lit(name).alias("value")).coalesce(1).write.text(f"{self.root}/staging/{name}")
        written = next(f.getPath() for f in self._fs.listStatus(self._path(f"staging/{name}")) if f.getPath().getName().startswith("part-"))
        self._fs.mkdirs(self._path("versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._fs.makeQualified(written), self._fs.makeQualified(self._path(f"versions/{base + 1:08d}")), never)
        self._fs.delete(self._path(f"staging/{name}"), True)
        return base + 1

    def _write(self, rows: DataFrame, level: int, version: int) -> DataFrame:
        """Writes one shard for each partition that has rows; returns their manifest rows."""
        folder = uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        meta = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{folder}").select("_metadata.file_name", "_metadata.file_size")
        shards = meta.groupBy("file_name", "file_size").count()
        rows_of = shards.select(
            F.lit(folder).alias("folder"), F.col("file_name").alias("file"), F.col("file_size").alias("bytes"), F.col("count").alias("rows"), F.lit(level).alias("level"),
            F.lit(version).cast("long").alias("added"), F.lit(rows.schema.json()).alias("columns"),
        )
        return rows_of.withColumn("written", F.count(F.lit(1)).over(W.partitionBy("folder"))).select(*MANIFEST.names)

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival; each of its partitions becomes a shard. Returns the new version."""
        base = self.version()
        manifest = self.manifest(base)
        _together([r["columns"] for r in manifest.select("columns").distinct().collect()] + [arrival.schema.json()])
        return self._commit(manifest.unionByName(self._write(arrival, 0, base + 1)), base)

    def _full_tiers(self, manifest: DataFrame) -> tuple[list, DataFrame]:
        t = self.tiers
        tier = F.floor(F.log(F.lit(t.target_bytes / 2) / F.greatest("bytes", F.lit(1))) / math.log(t.fanout))
        small = manifest.filter(F.col("bytes") < t.target_bytes / 2).withColumn("tier", tier)
        full = small.groupBy("tier").agg(F.count(F.lit(1)).alias("shards"), F.max("level").alias("level"))
        return full.filter(F.col("shards") >= t.fanout).orderBy(F.desc("tier")).collect(), small

    def compact(self) -> int:
        """Merges full tiers until there is none, the smallest shards first. Returns the newest version."""
        while True:
            base = self.version()
            manifest = self.manifest(base)
            full, small = self._full_tiers(manifest)
            if not full:
                return base
            merged = small.filter(F.col("tier") == full[0]["tier"]).orderBy("added", "folder", "file").limit(self.tiers.most_shards)
            files = max(1, round((merged.agg(F.sum("bytes")).first()[0] or 0) / self.tiers.target_bytes))
            fresh = self._write(self._rows(merged).coalesce(files), full[0]["level"] + 1, base + 1)
            rest = manifest.join(merged.select("folder", "file"), ["folder", "file"], "left_anti")
            self._commit(rest.select(*MANIFEST.names).unionByName(fresh), base)

    def _rows(self, shards: DataFrame) -> DataFrame:
        """The rows of some shards: whole folders by name, others file by file."""
        listed = F.when(F.count(F.lit(1)) < F.max("written"), F.collect_list("file"))
        folders = shards.groupBy("folder").agg(listed.alias("files")).orderBy("folder").collect()
        paths = [p for f in folders for p in ([f"{self.root}/data/{f['folder']}"] if f["files"] is None else [f"{self.root}/data/{f['folder']}/{x}" for x in sorted(f["files"])])]
        return self.spark.read.schema(self.schema(shards)).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with their shard in the column _metadata.file_path."""
        manifest = self.manifest(version)
        if not manifest.take(1):
            raise ValueError("the store has no rows, and so no columns")
        return self._rows(manifest)

    def _versions(self) -> list[tuple[int, int, str]]:
        """(version, when its pointer was written, its manifest's name) of all versions that can be read, in order."""
        folder = self._path("versions")
        files = [f for f in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if f.getPath().getName().isdigit()]
        if not files:
            return []
        rows = self.spark.read.text([f.getPath().toString() for f in files]).select(F.regexp_extract("_metadata.file_name", "[0-9]+", 0).cast("long"), "value").collect()
        name = dict(map(tuple, rows))
        return sorted((v, f.getModificationTime(), name[v]) for f in files for v in [int(f.getPath().getName())])

    def vacuum(self) -> int:
        """Drops versions whose next one is older than the grace period, then the shards and manifests that no version is
        left to list, if they are older than that themselves. Returns how many shards went. The driver sees a row for
        each version and for each folder of shards."""
        before = (time.time() - self.tiers.grace_s) * 1000
        versions = self._versions()
        out = [v for (v, _, _), (_, since, _) in zip(versions, versions[1:]) if since <= before]
        for v in out:
            self._fs.delete(self._path(f"versions/{v:08d}"), False)
        names = [name for v, _, name in versions if v not in out]
        listed = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifests/{n}" for n in names]) if names else self.manifest(0)
        listed = listed.select("folder", "file", "written").distinct()
        whole = {r["folder"]: r["held"] == r["written"] for r in listed.groupBy("folder").agg(F.count(F.lit(1)).alias("held"), F.max("written").alias("written")).collect()}
        gone = 0
        for folder in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = folder.getPath().getName()
            if whole.get(name) or folder.getModificationTime() > before:
                continue
            kept = {r["file"] for r in listed.filter(F.col("folder") == name).select("file").collect()} if name in whole else set()
            for f in self._fs.listStatus(folder.getPath()):
                if f.getPath().getName().startswith("part-") and f.getPath().getName() not in kept and f.getModificationTime() <= before:
                    gone += self._fs.delete(f.getPath(), False)
        for f in self._fs.listStatus(self._path("manifests")) if self._fs.exists(self._path("manifests")) else []:
            if f.getPath().getName() not in names and f.getModificationTime() <= before:
                self._fs.delete(f.getPath(), True)
        return gone


def compacted(docs: DataFrame, root: str, tiers: Tiers = Tiers(), *, arrivals: int = 6, key: str = "doc_id") -> DataFrame:
    """Appends a table to a new store in several arrivals (by a hash of the key), compacts it and reads it back: all
    columns in the struct doc, then shard (its file), shard_rows, shard_bytes, level and version."""
    store = ShardStore(docs.sparkSession, root, tiers)
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
    version = store.compact()
    manifest = store.manifest(version)
    if not manifest.take(1):
        return docs.limit(0).select(whole_row(), F.lit("").alias("shard"), *[F.lit(0).cast(t).alias(c) for c, t in (("shard_rows", "long"), ("shard_bytes", "long"), ("level", "int"), ("version", "long"))])
    shards = manifest.select(F.col("file").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "level")
    rows = store.read(version).select(F.struct("*").alias("doc"), F.col("_metadata.file_name").alias("in_file"))
    return rows.join(shards, F.col("in_file") == F.col("shard")).select("doc", "shard", "shard_rows", "shard_bytes", "level", F.lit(version).cast("long").alias("version"))
