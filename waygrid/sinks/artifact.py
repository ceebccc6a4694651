"""Several tables saved as one artifact, such as a built network: all of them are there, or none is.

Tables are written to a folder of their own first. The artifact exists from the moment its pointer, written aside, is
renamed to ``pointers/<key>``; renaming never overwrites, so of two writers of one key the first counts and the other
reads what that one wrote. A job that dies leaves files that no pointer names.

A pointer tells its format and version, and of each table its schema, rows, files and bytes. Loading compares these with
what lies there, by listing and without reading rows: an artifact of another format or version, or one that is cut short or
lacks a table, is refused with its reason, and ``load_or_build`` builds it anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMAT, VERSION = "waygrid-tables", 1


class Refused(ValueError):
    """An artifact that can't be used, and why."""


def inputs_key(spark: SparkSession, paths: Sequence[str], *parameters: object) -> str:
    """A key of what an artifact is built from: the format's version, parameters, and of each input its path, bytes and time."""
    lines = [f"{FORMAT} {VERSION}", *map(repr, parameters)]
    for p in sorted(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        lines.append(f"{p} {fs.getContentSummary(path).getLength()} {fs.getFileStatus(path).getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _size(self, folder: str) -> dict[str, int]:
        """Files and bytes of a table's folder."""
        found = self._fs.getContentSummary(self._path(folder))
        return {"files": found.getFileCount(), "bytes": found.getLength()}

    def save(self, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Writes the tables and commits them under the key; if another writer was first, what that one wrote counts."""
        folder = f"data/{uuid4().hex}"
        held = {}
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{folder}/{name}")
            written = self.spark.read.schema(table.schema).parquet(f"{self.root}/{folder}/{name}")
            held[name] = self._size(f"{folder}/{name}") | {"rows": written.count(), "schema": json.loads(table.schema.json())}
        self._point(key, {"format": FORMAT, "version": VERSION, "folder": folder, "tables": held})
        return self.load(key)

    def _point(self, key: str, pointer: dict) -> None:
        aside = self._path(f"staging/{uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path("pointers"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"pointers/{key}")), never)
        except Exception:
            self._fs.delete(aside, False)
            if not self.exists(key):
                raise

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(f"pointers/{key}"))

    def pointer(self, key: str) -> dict:
        if not self.exists(key):
            raise Refused(f"there is no artifact {key}")
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/pointers/{key}").collect())  # one short file
        try:
            found = json.loads(text)
        except ValueError:
            raise Refused("the pointer is no artifact's: not JSON") from None
        if not isinstance(found, dict) or found.get("format") != FORMAT:
            raise Refused(f"the pointer is no artifact's: its format is not {FORMAT}")
        if found.get("version") != VERSION:
            raise Refused(f"the artifact has version {found.get('version')}, this is version {VERSION}: build it again")
        return found

    def load(self, key: str, wanted: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The tables of an artifact by name, with the columns and types they were written with; Refused if anything is amiss."""
        found = self.pointer(key)
        missing = [n for n in wanted if n not in found["tables"]]
        if missing:
            raise Refused(f"the artifact lacks the tables {missing}")
        tables = {}
        for name, told in found["tables"].items():
            folder = f"{found['folder']}/{name}"
            lies = self._size(folder) if self._fs.exists(self._path(folder)) else {"files": 0, "bytes": 0}
            if any(lies[c] != told[c] for c in ("files", "bytes")):
                raise Refused(f"the artifact is cut short: {name} has {lies}, its pointer says {told['files']} files of {told['bytes']} bytes")
            tables[name] = self.spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(f"{self.root}/{folder}")
        return tables

    def load_or_build(self, key: str, build: Callable[[], dict[str, DataFrame]], wanted: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The artifact of a key, built and saved where there is none or where it is refused."""
        if self.exists(key):
            try:
                return self.load(key, wanted)
            except Refused:
                self._fs.delete(self._path(f"pointers/{key}"), False)
        return self.save(key, build())
