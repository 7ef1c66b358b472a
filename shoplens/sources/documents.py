"""JSON documents, landed feed pages, reference regions and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.schemas import FEED_PAGES, ddl


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per row on any Hadoop file system."""
    df.write.mode(mode).json(path)


#: Where the text of a document that cannot be read is kept.
UNREADABLE = "unreadable"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Documents under a stated schema; nothing is inferred.

    A schema with a field ``unreadable`` gets the text of documents that cannot be read there.
    """
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    return reader.option("columnNameOfCorruptRecord", UNREADABLE).json(path)


def read_feed(spark: SparkSession, path: str, feed: str, multi_line: bool = False) -> DataFrame:
    """Pages of a feed landed under ``client_id=...`` folders or carrying a client_id field."""
    return read_json(spark, path, f"client_id string, {FEED_PAGES[feed]}, {UNREADABLE} string", multi_line)


def parse_pages(pages: DataFrame, feed: str) -> DataFrame:
    """Pages delivered as text (client_id, body); an unreadable body stays as text beside a null page."""
    page = F.from_json("body", f"{FEED_PAGES[feed]}, {UNREADABLE} string", {"columnNameOfCorruptRecord": UNREADABLE})
    return pages.select("client_id", page.alias("p")).select("client_id", "p.*")


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """The pages (client_id, unreadable) that could not be read; none if the pages do not keep their text."""
    if UNREADABLE not in pages.columns:
        return pages.select("client_id", F.lit(None).cast("string").alias(UNREADABLE)).filter(F.lit(False))
    return pages.filter(F.col(UNREADABLE).isNotNull()).select("client_id", UNREADABLE)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The region reference; each geometry stays the JSON text it came as."""
    return read_json(spark, path, ddl("regions"), multi_line=True)


def list_files(spark: SparkSession, folder: str, prefix: str = "", max_count: int | None = None) -> DataFrame:
    """Names of the files under a folder that start with a prefix, in order."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{prefix}*")
        .load(folder)
        .select(F.substring_index("path", "/", -1).alias("name"), "path", "length")
        .orderBy("path")
    )
    return files if max_count is None else files.limit(max_count)
