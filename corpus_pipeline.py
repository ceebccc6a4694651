"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents`` and whatever else it came with,
and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from waygrid.llm import minhash_dedup, mixing, pii, quality_rules, sentencepiece_codec
from waygrid.llm.queries import PIECE_MODEL
from waygrid.llm.shared import DOCUMENTS, shared_folder, table


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_rules(docs).filter("kept").select("doc.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is replaced by its kind."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target shares; a document that is taken again comes again."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    return sentencepiece_codec.encode_texts(docs, PIECE_MODEL, keep=["doc_id", "source"]).select("doc.*", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", judge), ("near_duplicates", deduplicate), ("personal_data", hide_personal_data), ("mixing", mix), ("tokens", encode)]

#: Stages run Python inside tasks and iterate, so there is no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each of them kept is written to the shared folder."""
    docs = table(spark, sf_dir, DOCUMENTS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
