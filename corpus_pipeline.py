"""From documents to packed token ids: five corpus operators in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import decontaminate, mixing, neardup, quality, tokens
from shoplens.llm.common import landed, n_words, packed, table
from shoplens.llm.queries import SOURCE_WEIGHTS, public_vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), "doc_id", packed(docs))
    return judged.filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document as often as the mix takes it: rows repeat or go, texts stay whole."""
    return mixing.mixed(docs, n_words(F.col("text")), SOURCE_WEIGHTS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.packed_documents(docs, public_vocabulary())


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix_sources),
    ("token ids", pack_tokens),
]

#: The learned rules and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
