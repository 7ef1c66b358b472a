"""Matches of patterns in texts as rows with code point offsets, and which of them others overrule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import let

NO_HITS = "array<struct<gap:int,hit:string,left:string,right:string>>"
LEFT_CONTEXT, RIGHT_CONTEXT = 40, 4


def hits(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches with the length of the gap before each, and some text on either side.

    The context stops at the neighbouring matches of the same pattern.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def each(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            return F.transform(
                found,
                lambda hit, i: F.struct(
                    F.length(gaps[i]).alias("gap"),
                    hit.alias("hit"),
                    F.right(gaps[i], F.lit(LEFT_CONTEXT)).alias("left"),
                    F.left(gaps[i + 1], F.lit(RIGHT_CONTEXT)).alias("right"),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(NO_HITS))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), each)


def located(rows: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """One row per hit of the array column ``found``, with ``start`` and ``end`` (code points, end exclusive).

    The offsets are running sums over the hits of one text and pattern (``keys``).
    """
    each = rows.select(*keys, F.posexplode(found).alias("_place", "_hit")).select(*keys, "_place", "_hit.*")
    so_far = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("_place", "gap")


def overruled(rows: DataFrame, key: str, levels: Sequence[int], tie: str) -> DataFrame:
    """Adds ``overruled``: the span overlaps a kept one of higher ``level``, or lies inside an earlier one of its own.

    Earlier means smaller start, then larger end, then smaller ``tie``. Levels are settled from the
    highest down, and only spans that are not overruled themselves count. Running extremes per
    level find this in sorted order, without pairs of spans and with one shuffle.
    """
    ahead = Window.partitionBy(key).orderBy("start", F.desc("end"), tie).rowsBetween(Window.unboundedPreceding, -1)
    behind = (
        Window.partitionBy(key)
        .orderBy(F.desc("start"), "end", F.desc(tie))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    no = F.lit(False)
    out = rows.withColumn("_kept", no)
    for own in sorted(levels, reverse=True):
        out = out.withColumn("_next", F.min(F.when(F.col("_kept"), F.col("start"))).over(behind))
        out = out.withColumn("_reach", F.max(F.when(F.col("_kept"), F.col("end"))).over(ahead))
        clash = F.coalesce(F.col("_reach") > F.col("start"), no) | F.coalesce(F.col("_next") < F.col("end"), no)
        out = out.withColumn("_free", (F.col("level") == own) & ~clash)
        out = out.withColumn("_around", F.max(F.when(F.col("_free"), F.col("end"))).over(ahead))
        inside = F.coalesce(F.col("_around") >= F.col("end"), no)
        out = out.withColumn("_kept", F.col("_kept") | (F.col("_free") & ~inside))
    return out.withColumn("overruled", ~F.col("_kept")).drop("_kept", "_next", "_reach", "_free", "_around")
