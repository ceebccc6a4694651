"""Cutting lineage between rounds of iterative operators, in the folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one for a local run where it is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="waygrid-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the table to the shared folder and reads on: a lost executor costs only its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unioned(*tables: DataFrame, number: str) -> DataFrame:
    """The rows of tables of which some were cut. A table that was cut keeps what its old plan knew of its columns, in the
    plan's own ids, and the optimiser's rule for unions fails on those ("key not found"). A double column, ``number``, that is
    computed anew puts a projection between them, which drops what does not belong to its own columns."""
    fresh = [t.withColumn(number, F.col(number) + F.lit(0.0)) for t in tables]
    out = fresh[0]
    for t in fresh[1:]:
        out = out.unionByName(t)
    return out
