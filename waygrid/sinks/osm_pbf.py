"""Writing elements as OpenStreetMap PBF: each task writes its partition as a complete file of its own."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from waygrid.plans.lineage import cut

BLOCK, SUFFIX = 8000, ".osm.pbf"


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(number: int, values: Sequence[int], delta: bool = False, signed: bool = False) -> bytes:
    if delta:
        values = [v - w for v, w in zip(values, [0, *values[:-1]])]
    return field(number, b"".join(varint(zigzag(v) if signed else v) for v in values)) if values else b""


def framed(kind: bytes, message: bytes) -> bytes:
    blob = field(2, len(message)) + field(3, zlib.compress(message))
    head = field(1, kind) + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def block(rows: list, dense: bool = False) -> bytes:
    """One primitive block of rows of one kind; dense nodes are columns of differences, which a header must name."""
    strings: dict[str, int] = {"": 0}
    code = lambda s: strings.setdefault(s, len(strings))
    groups = []
    if dense and rows[0].kind == "node":
        # One run of key and value numbers for the whole block; a zero ends each node's, tagged or not.
        run = [n for r in rows for n in (*(code(x) for pair in (r.tags or {}).items() for x in pair), 0)]
        numbers = [packed(k, [getattr(r, c) for r in rows], True, True) for k, c in ((1, "id"), (8, "lat_e7"), (9, "lon_e7"))]
        groups, rows = [field(2, b"".join(numbers) + packed(10, run))], []
    for r in rows:
        tags = r.tags or {}
        keys, values = packed(2, [code(k) for k in tags]), packed(3, [code(v) for v in tags.values()])
        if r.kind == "node":
            groups.append(field(1, field(1, zigzag(r.id)) + keys + values + field(8, zigzag(r.lat_e7)) + field(9, zigzag(r.lon_e7))))
        elif r.kind == "way":
            groups.append(field(3, field(1, r.id) + keys + values + packed(8, list(r.refs or []), True, True)))
        else:
            m = r.members or []
            types = [("node", "way", "relation").index(x["type"]) for x in m]
            groups.append(field(4, field(1, r.id) + keys + values + packed(8, [code(x["role"]) for x in m]) + packed(9, [x["ref"] for x in m], True, True) + packed(10, types)))
    table = b"".join(field(1, s.encode()) for s in strings)
    return field(1, table) + field(2, b"".join(groups))


def placed(path: str):
    """The file system that a path or URI names, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def parts(path: str) -> list[str]:
    """The files of a folder of parts in their order, or the file itself."""
    from pyarrow import fs

    system, at = placed(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [at]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-") and f.base_name.endswith(SUFFIX))


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class PbfWriter(DataSourceWriter):
    """Parts are written aside and renamed when all are whole: behind those that are there, or in their stead. Ways of
    fewer than two references are left out. Options: dense (nodes as columns), sorted (the rows come by kind and id), and bbox (left, right, top,
    bottom in 1e-7 degrees)."""

    def __init__(self, path: str, overwrite: bool, options: dict | None = None):
        self.path, self.overwrite = path, overwrite
        options = options or {}
        self.sorted, self.dense = (options.get(o, "").lower() == "true" for o in ("sorted", "dense"))
        self.bbox = [int(x) * 100 for x in options["bbox"].split(",")] if options.get("bbox") else []

    def _header(self) -> bytes:
        box = b"".join(field(i + 1, zigzag(x)) for i, x in enumerate(self.bbox))
        out = field(1, box) if box else b""
        out += field(4, b"OsmSchema-V0.6") + (field(4, b"DenseNodes") if self.dense else b"")
        return framed(b"OSMHeader", out + (field(5, b"Sort.Type_then_ID") if self.sorted else b"") + field(16, b"waygrid"))

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = placed(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        count, held = 0, []
        with system.open_output_stream(name) as f:
            f.write(self._header())
            for r in rows:
                if r.kind == "way" and len(r.refs or []) < 2:
                    continue
                if held and (held[-1].kind != r.kind or len(held) == BLOCK):
                    f.write(framed(b"OSMData", block(held, self.dense)))
                    held = []
                held.append(r)
                count += 1
            if held:
                f.write(framed(b"OSMData", block(held, self.dense)))
        return Part(name, count)

    def commit(self, messages) -> None:
        system, folder = placed(self.path)
        system.create_dir(folder, recursive=True)
        old = parts(self.path)
        first = int(old[-1].rsplit("part-", 1)[1][: -len(SUFFIX)]) + 1 if old else 0
        for i, m in enumerate(m for m in messages if m):
            system.move(m.path, f"{folder}/part-{first + i:05d}{SUFFIX}")
        for name in old if self.overwrite else ():
            system.delete_file(name)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                placed(self.path)[0].delete_file(m.path)


def clipped(elements: DataFrame) -> DataFrame:
    """Elements (kind, id, lat_e7, lon_e7, refs, members, tags) as a file may hold them: references of ways to nodes that
    are not among them are left out (adds dangling, their number), in the order that the rest had."""
    nodes = elements.filter("kind = 'node'").select(F.col("id").alias("node_id")).distinct()
    ways = elements.filter("kind = 'way'").withColumn("row", F.monotonically_increasing_id())
    ways = cut(ways)  # the numbers of rows must not change between the two sides
    refs = ways.select("row", F.posexplode("refs").alias("pos", "node_id")).join(nodes, "node_id", "left_semi")
    kept = refs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("kept"))
    ways = ways.join(kept, "row", "left").withColumn("left", F.coalesce(F.transform("kept", lambda x: x["node_id"]), F.array().cast("array<bigint>")))
    ways = ways.withColumn("dangling", F.coalesce(F.size("refs"), F.lit(0)) - F.size("left")).withColumn("refs", F.col("left")).drop("row", "kept", "left")
    return elements.filter("kind <> 'way'").withColumn("dangling", F.lit(0)).unionByName(ways)


def write_sorted(elements: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Writes elements as one run of part files in the order of kinds (nodes, ways, relations) and ids, in the stead of what
    the folder holds, and tells in one row what was written and left out: nodes, ways, relations, dangling (references to
    nodes that are not there), too_short (ways that had fewer than two left).

    Rows are dealt by ranges of kind and id into so many files, or as adaptive execution sees fit; no task sees more than a
    range. A row without a kind or an id is left out."""
    spark = elements.sparkSession
    order = F.when(F.col("kind") == "node", 0).when(F.col("kind") == "way", 1).when(F.col("kind") == "relation", 2)
    fit = cut(clipped(elements.filter("id is not null and kind in ('node', 'way', 'relation')")).withColumn("kind_order", order))
    short = (F.col("kind") == "way") & (F.size("refs") < 2)
    count = lambda kind: F.count_if((F.col("kind") == kind) & ~short)
    at = lambda f, c: f(F.when(F.col("kind") == "node", F.col(c)))
    box = [at(F.min, "lon_e7"), at(F.max, "lon_e7"), at(F.max, "lat_e7"), at(F.min, "lat_e7")]
    told = fit.agg(
        count("node").alias("nodes"), count("way").alias("ways"), count("relation").alias("relations"), F.coalesce(F.sum("dangling"), F.lit(0)).alias("dangling"), F.count_if(short).alias("too_short"),
        *[c.alias(f"box{i}") for i, c in enumerate(box)],
    )
    row = told.collect()[0]  # one row
    bbox = ",".join(str(row[f"box{i}"]) for i in range(4)) if row["box0"] is not None else ""
    ranged = fit.filter(~short).repartitionByRange(*([files] if files else []), "kind_order", "id").sortWithinPartitions("kind_order", "id")
    out = ranged.select("kind", "id", "lat_e7", "lon_e7", "refs", "members", "tags", F.lit(None).cast("bigint").alias("ord"))
    out.write.format("osm_pbf").mode("overwrite").option("sorted", "true").option("dense", "true").option("bbox", bbox).save(path)
    names = ["nodes", "ways", "relations", "dangling", "too_short"]
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
