"""Versioned table sinks: parquet with a key of what it was built from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def cache_key(spark: SparkSession, area: dict, extracts: Sequence[tuple[str, str]]) -> str:
    """SHA-256 of the format's version, the area and the sorted (name, checksum) of all extracts."""
    lines = [f"v{FORMAT_VERSION}", *(f"{k}:{a}:{b}" for k, (a, b) in sorted(area.items())), *sorted(f"{n}:{c}" for n, c in extracts)]
    return spark.range(1).select(F.sha2(F.lit("\n".join(lines)), 256)).first()[0]


def load_or_build(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path if it carries the key, else built and written anew. The key is the name of a folder below the
    path, so a table of another key is never read or overwritten. A folder without the mark of a finished write is what
    a job that died left, and is built again."""
    folder = f"{path}/key={key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A place table; an empty one is an error."""
    places = spark.read.parquet(path)
    if not places.take(1):
        raise ValueError("the place table is empty")
    return places


def write_report(stats: DataFrame, path: str) -> None:
    """A small report as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)
