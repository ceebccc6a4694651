"""Small helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waygrid.llm.text import runs

DOCUMENTS, EMBEDDINGS, LABELS = "documents", "embeddings", "labels"
#: Bytes of rows that Spark sends to Python at once.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Rows of a few short columns that may be sent to all tasks: some 20 MB.
SENT_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one for a local run where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="waygrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and goes on from there: a lost executor costs only its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_row(keep: Sequence[str] | None = None) -> Column:
    """Columns as one struct ``doc``, so that columns that an operator adds can't clash with them."""
    return F.struct(*(["*"] if keep is None else [F.col(f"`{c}`") for c in keep])).alias("doc")


def arrow_batches(spark: SparkSession) -> None:
    """Has Spark cut the batches that it sends to Python by bytes and not by rows alone, unless the session already does."""
    if spark.conf.get(BATCH_CONF, "1b") == "1b":  # unset
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def small(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df, marked to be sent to all tasks if a count finds it small enough; else joins deal it out. For tables that are
    cheap to count (written ones) and have short rows."""
    return F.broadcast(df) if df.count() <= most else df


def map_texts(df: DataFrame, compute: Callable[[pa.RecordBatch, dict], list], fields: str, *, keep: Sequence[str] | None = None, text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """Adds columns that follow from each row's text: rows stay where they are, nothing is shuffled.

    compute(batch, state) gets a batch of rows with about RUN_BYTES of text: the kept struct, the text, then the
    ``more`` columns. It returns one array for each of ``fields`` (a DDL list). state is a dict of the task's own. The
    result has the columns ``keep`` (None: all) in the struct ``doc``, then the fields. A text that is among the kept
    columns is sent once.
    """
    inside = keep is None and df.schema[text].dataType == T.StringType()
    own = [] if inside else [F.col(text).cast("string").alias("text")]
    return map_rows(df.select(whole_row(keep), *own, *more), compute, fields, df.columns.index(text) if inside else None)


def map_rows(rows: DataFrame, compute: Callable[[pa.RecordBatch, dict], list], fields: str, inside: int | None = None) -> DataFrame:
    """map_texts of rows that have the columns ``doc`` and ``text`` first and then any others; with ``inside``, the text
    is that column of doc instead."""
    arrow_batches(rows.sparkSession)
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([rows.schema["doc"], *added.fields])
    names = schema.names

    def run(batches):
        state: dict = {}
        for batch in batches:
            columns = list(batch.columns)
            if inside is not None:
                columns.insert(1, columns[0].field(inside))
            labels = [str(i) for i in range(len(columns))]
            for begin, end in runs(columns[1]):
                part = pa.RecordBatch.from_arrays([c.slice(begin, end - begin) for c in columns], labels)
                yield pa.RecordBatch.from_arrays([part.column(0), *compute(part, state)], names)
            del batch, columns
        state.clear()
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)
