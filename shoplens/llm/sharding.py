"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed, numbered, packed, seeded_key

SEED = 11


def interleave(rows: DataFrame, shards: int, seed: int = SEED, tie: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows into ``shards`` so that each shard has the mixture of sources of the whole table.

    Rows of a source (null is a source of its own) are shuffled by a seeded hash of ``doc_id`` and
    ranked; the fractional rank (rank + 0.5) / rows of the source interleaves the sources evenly,
    and the interleaved order is cut at equal counts, so shards differ by one row at most. Ties go
    by hash, id and then the ``tie`` columns; a repeated row gets a place of its own, equal in all
    else. Returns ``row`` (all given columns, whatever their names), ``shard`` and ``slot`` (place in
    the shard, from 0). An empty table gives no rows. Carry narrow columns only: two range shuffles
    move them.
    """
    last = ["_key", *[f"row.{name}" for name in ("doc_id", *tie)]]
    key = seeded_key(seed, "doc_id").alias("_key")
    keyed = landed(rows.select(packed(rows), "source", key), "shard-keys")
    ranked = numbered(keyed, ["source", *last])
    ranked = landed(ranked, "shard-ranks")
    sources = landed(
        ranked.groupBy(F.col("source").alias("_source")).agg(
            F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n")
        ),
        "shard-sources",
    )
    total = sources.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    share = (F.col("rank") - F.col("_first") + F.lit(0.5)) / F.col("_n")
    mixed = ranked.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_share", share)
    mixed = numbered(mixed.drop("rank", "_source", "_first", "_n"), ["_share", *last])
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    slot = F.expr(f"rank - (shard * {total} + {shards - 1}) div {shards}")
    dealt = mixed.withColumn("shard", shard)
    return dealt.select("row", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
