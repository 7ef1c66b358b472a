"""Word rule, landing and distributed numbering shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.session import shared_dir

#: A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _LOWER)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that columns an operator adds clash with none of them."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def seeded_key(seed: int, id_column: str) -> Column:
    """A stable pseudo-random text key of an id; another engine's md5 gives the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))


def numbered(df: DataFrame, order: list[Column | str], value: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 0, in the given order) and, for ``value``, ``before``: the sum of all earlier rows.

    Rows are dealt by range, so no task sorts more than its share; each range is numbered on
    its own and shifted by the totals of the ranges before it, one row per range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = landed(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = ranges.withColumn("_range", F.shiftright("_at", _ROW_BITS))
    amount = F.sum(value) if value else F.lit(0)
    totals = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), amount.alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
    )
    out = ranges.join(F.broadcast(starts), "_range")  # one row per range of the sort
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = out.withColumn("rank", F.col("_rows_before") + row)
    if value:
        inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_sum_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_at", "_range", "_rows_before", "_sum_before")
