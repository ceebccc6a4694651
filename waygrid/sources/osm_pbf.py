"""OpenStreetMap PBF files as a Spark data source.

The file's blobs are independent: planning reads only their headers, each partition is a range of blobs, and tasks
inflate and decode their own. Rows are (kind, id, lat_e7, lon_e7, refs, members, tags, ord).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waygrid.sinks.osm_pbf import PbfWriter, parts, placed

SCHEMA = "kind string, id bigint, lat_e7 int, lon_e7 int, refs array<bigint>, members array<struct<type: string, ref: bigint, role: string>>, tags map<string, string>, ord bigint"
#: Fixed values of the format.
MOST_HEADER, MEMBER_TYPES = 64 * 1024, ("node", "way", "relation")


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers and values of a message: integers, or the bytes of strings, messages and packed lists."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at > len(data):
            raise ValueError("a field runs past the end")
        yield key >> 3, value


def packed(data: memoryview, signed: bool = False, summed: bool = False) -> list[int]:
    out, at, total = [], 0, 0
    while at < len(data):
        n, at = varint(data, at)
        n = zigzag(n) if signed else n
        total += n
        out.append(total if summed else n)
    return out


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Type, place and size of each blob; bodies are skipped."""
    system, at = placed(path)
    with system.open_input_file(at) as f:
        while head := f.read(4):
            (size,) = struct.unpack(">I", head)
            if size > MOST_HEADER:
                raise ValueError("a blob header is too long")
            header = dict(fields(memoryview(f.read(size))))
            place = f.tell()
            yield bytes(header[1]).decode(), place, header[3]
            f.seek(header[3], 1)


def inflate(blob: bytes) -> memoryview:
    told = dict(fields(memoryview(blob)))
    if 1 in told:
        return told[1]
    if 3 in told:
        return memoryview(zlib.decompress(told[3]))
    raise ValueError("only raw and zlib blobs are read")


def header(path: str) -> dict:
    """Features and bounding box (degrees: left, right, top, bottom) of the file's first blob."""
    kind, place, size = next(blobs(path))
    if kind != "OSMHeader":
        raise ValueError("the file does not begin with a header")
    system, at = placed(path)
    with system.open_input_file(at) as f:
        f.seek(place)
        told = list(fields(inflate(f.read(size))))
    box = next((v for k, v in told if k == 1), None)
    return {"bbox": [zigzag(v) / 1e9 for _, v in sorted(fields(box))] if box is not None else None, "required": [bytes(v).decode() for k, v in told if k == 4], "optional": [bytes(v).decode() for k, v in told if k == 5]}


def decode(block: memoryview) -> Iterator[tuple]:
    """Rows of one primitive block, in file order, without their number."""
    top = list(fields(block))
    strings = [bytes(v).decode("utf-8", "replace") for k, m in top if k == 1 for _, v in fields(m)]
    scale = {k: v for k, v in top if k in (17, 19, 20)}
    step, lat0, lon0 = scale.get(17, 100), _signed(scale.get(19, 0)), _signed(scale.get(20, 0))

    def degrees(n: int, offset: int) -> int:
        return (offset + step * n + 50) // 100

    def tags(parts: dict) -> dict:
        return {strings[k]: strings[v] for k, v in zip(packed(parts.get(2, memoryview(b""))), packed(parts.get(3, memoryview(b""))))}

    for k, group in top:
        if k != 2:
            continue
        for number, body in fields(group):
            if number == 2:
                d = dict(fields(body))
                words = iter(packed(d.get(10, memoryview(b""))))
                for node, lat, lon in zip(*(packed(d[n], True, True) for n in (1, 8, 9))):
                    own = {}
                    while 10 in d and (key := next(words, 0)):
                        own[strings[key]] = strings[next(words)]
                    yield "node", node, degrees(lat, lat0), degrees(lon, lon0), None, None, own
            elif number == 1:
                d = dict(fields(body))
                yield "node", zigzag(d[1]), degrees(zigzag(d[8]), lat0), degrees(zigzag(d[9]), lon0), None, None, tags(d)
            elif number == 3:
                d = dict(fields(body))
                yield "way", d[1], None, None, packed(d.get(8, memoryview(b"")), True, True), None, tags(d)
            elif number == 4:
                d = dict(fields(body))
                roles, refs, kinds = (packed(d.get(n, memoryview(b"")), n == 9, n == 9) for n in (8, 9, 10))
                yield "relation", d[1], None, None, None, [(MEMBER_TYPES[t] if t < 3 else "node", ref, strings[role]) for role, ref, t in zip(roles, refs, kinds)], tags(d)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


class BlobRange(InputPartition):
    def __init__(self, number: int, places: list[tuple[str, int, int]]):
        super().__init__(number)
        self.number, self.places = number, places


class PbfReader(DataSourceReader):
    def __init__(self, path: str, blobs_per_partition: int):
        self.path, self.per = path, blobs_per_partition

    def partitions(self) -> list[BlobRange]:
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else ""
        found = [(scheme + file, place, size) for file in parts(self.path) for kind, place, size in blobs(scheme + file) if kind == "OSMData"]
        return [BlobRange(i, found[i : i + self.per]) for i in range(0, len(found), self.per)] or [BlobRange(0, [])]

    def read(self, partition: BlobRange) -> Iterator[tuple]:
        for k, (file, place, size) in enumerate(partition.places):
            system, at = placed(file)
            with system.open_input_file(at) as f:
                f.seek(place)
                for i, row in enumerate(decode(inflate(f.read(size)))):
                    yield (*row, (partition.number + k) * 1_000_000 + i)


class PbfSource(DataSource):
    """spark.read.format("osm_pbf").load(file or folder of parts), and df.write.format("osm_pbf").save(folder), after
    register(spark). The path is a local one that all executors can open, or the URI of a file system that Arrow knows. ``ord``
    is an element's place in the file, or in the parts in their order."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], int(self.options.get("blobsPerPartition", 16)))

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        return PbfWriter(self.options["path"], overwrite, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbfSource)
