"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed, numbered, packed, seeded_key

SEED = 7
MAX_EPOCHS = 3


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight`` to a table of sources: the given weights in turn, sources by code point, null last."""
    ranked = numbered(sizes, [F.asc_nulls_last("source")])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", turn[F.pmod("rank", F.lit(len(weights))).cast("int")]).drop("rank")


def water_level(sources: DataFrame, total: float) -> float:
    """The level whose min(cap, level * weight) add up to ``total``; infinite if all caps are too small.

    Sources above their cap are clamped and the rest of the total is shared anew by weight, until
    no source is above. A clamped source stays clamped, as the level only rises, so the level is
    all that is carried from round to round: each round is one aggregate of the source table.
    """
    level = 0.0
    clamped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("used"),
            F.sum(F.when(clamped, F.lit(0.0)).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row.open:
            return math.inf
        rest, open_weight = float(total - row.used), row.open
        now = rest / open_weight
        if now <= level:
            return level
        level, clamped = now, F.col("weight") * F.lit(now) > F.col("cap")


def plan(slim: DataFrame, weights: tuple[float, ...], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its size, target, whole repetitions and the last key that gets one more.

    ``slim`` has source, ``size`` and the shuffling keys ``_key`` and ``doc_id``. The fractional
    repetition goes to the rows first in seeded order, up to the prefix whose size is nearest to
    what is missing; their running size comes from a range sort, never from one task per source.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    sources = landed(cyclic_weights(sources, weights), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, total)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("target", target).withColumn("whole", whole.cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = landed(sources, "mix-targets")

    running = landed(numbered(slim, ["source", "_key", "doc_id", "size"], "size"), "mix-running")
    first = running.groupBy(F.col("source").alias("_source")).agg(F.min("before").alias("_base"))
    inside = F.col("before") - F.col("_base")
    taken = (F.col("rest") > 0) & (inside * 2 + F.col("size") <= F.col("rest") * 2)
    edges = (
        running.join(landed(first, "mix-first"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("source")
        .join(sources.select(F.col("source").alias("_s"), "rest"), F.col("_source").eqNullSafe(F.col("_s")))
        .filter(taken)
        .groupBy("_source")
        .agg(F.max(F.struct("_key", "doc_id")).alias("edge"))
    )
    joined = sources.join(edges, F.col("source").eqNullSafe(F.col("_source")), "left")
    return landed(
        joined.select(F.col("source").alias("_source"), "source_size", "target", "whole", "edge"), "mix-plan"
    )


def copies(
    docs: DataFrame, size: Column, weights: tuple[float, ...], max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, ``source_size``, ``target`` and ``copies``: how often it is taken.

    ``size`` is an expression over ``docs`` with whole values (null counts 0). Sources are weighed in
    turn, null is a source of its own and comes last. No row gets more than ``max_epochs`` copies;
    empty rows are taken like others. Rows that repeat an id share its hash and are taken together;
    a source without size gets target 0 and no copies. Reruns agree, as the order is a hash of the
    ids. An empty table gives no rows. The documents meet the plan at one row per source, so their
    texts are not shuffled.
    """
    size = F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size")
    keyed = docs.select(packed(docs), "doc_id", "source", size, seeded_key(seed, "doc_id").alias("_key"))
    sources = plan(landed(keyed.drop("row"), "mix-slim"), weights, max_epochs)
    more = F.col("edge").isNotNull() & (F.struct("_key", "doc_id") <= F.col("edge"))
    out = keyed.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left")
    taken = (F.col("whole") + more.cast("long")).alias("copies")
    return out.select("row", "size", "source_size", "target", taken)


def mixed(
    docs: DataFrame, size: Column, weights: tuple[float, ...], max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = copies(docs, size, weights, max_epochs, seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
