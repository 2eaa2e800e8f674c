"""The corpus pipeline: stages of the llm operators, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.decontamination import clean, find_contamination
from tarnflow.llm.language import UNKNOWN, identify
from tarnflow.llm.mixing import emit_copies, mix_sources
from tarnflow.llm.shared import crc_fold, documents, written
from tarnflow.llm.sharding import assign_shards
from tarnflow.llm.simhash import keep_one


#: Rows of whole texts that go to Python at once, in every stage: few, as some texts are very long.
BATCH_ROWS = 1000


def _lean(spark: SparkSession) -> None:
    """A stage's rows are computed after it returns, so this holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go: null ones and those without letters.  A short text's cosine says little, so none goes for it.

    A tie of languages does not matter here; repeated rows fare alike; no rows give no rows.
    """
    _lean(spark)
    found = identify(docs, crc_fold(F.col("doc_id")) != 1)
    return found.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id: five-word shingles, similarity 0.8.

    Of equal ids the text with the least hash stays, of repeated rows one; a null id is the least; texts without
    words are one group.  No rows give no rows.
    """
    _lean(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts have none and stay.

    Repeated rows fare alike; without items, or without rows, nothing changes.
    """
    _lean(spark)
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean(found).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight asks for; a null source is one of its own.

    A document without words gets copies if its source has any words.  Repeated rows count one by one; no rows give no rows.
    """
    return emit_copies(mix_sources(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard; equal ids, null ones too, share a shard.  No rows give no rows."""
    return assign_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL has neither the language profiles nor the shingle sets; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
