"""The registered queries of the corpus operators and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import (
    decontaminate,
    licenses,
    linedups,
    mixing,
    neardup,
    pii,
    quality,
    ranked,
    secret_scan,
    sharding,
    tokens,
    trie,
    warc,
)
from shoplens.llm.common import landed, n_words, table, text_or_empty
from shoplens.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

N_SHARDS = 40
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.copies(docs.select("doc_id", "source", "text"), n_words(F.col("text")), SOURCE_WEIGHTS)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix.select("row.doc_id", "size", "source_size", "target", taken)


@query
def op10_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.interleave(docs, N_SHARDS, tie=("size", "text_crc32"))
    return dealt.select(
        "row.doc_id",
        "row.size",
        "row.text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = landed(warc.read_archives(spark, path, payloads=False), "warc-records")
    captures = warc.assemble(records).filter("response is not null")
    full = F.coalesce(F.col("original.response"), F.col("response"))
    return captures.select(
        "page_id",
        full["payload_bytes"].alias("payload_bytes"),
        full["payload_digest"].alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
    )


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed_documents(table(spark, sf_dir, "documents"), public_vocabulary())


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), "doc_id")
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


@query
def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = pii.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = rows.join(pii.listed(spans), "_row", "left")
    return out.select(
        "row.doc_id",
        *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in pii.BASE_KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


@query
def op9_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("row.doc_id", *columns)


@query
def op8_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("first").alias("kept"))


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row per document and benchmark item that it contains."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    coverage = (F.col("covered_words") / F.col("item_words")).alias("coverage")
    return found.select("doc_id", "item_id", "n_tiles", "covered_words", "item_words", coverage)


@query
def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many repeat an earlier line up to a few edits, and each line's class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = linedups.summarized(docs).withColumnRenamed("doc_id", "_doc")
    rows = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("_hash"))
    out = rows.join(lines, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("row_hash")), "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select("doc_id", count("n_lines"), count("n_repeated"), "first_docs")


@query
def op11_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_random",
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


@query
def op13_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
