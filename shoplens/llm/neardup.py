"""Near-duplicate documents by SuperMinHash, exact confirmation and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import landed, numbered, packed, text_or_empty
from shoplens.llm.components import connected
from shoplens.llm.shingles import band_keys, forget, shingle_set, signatures

#: Linked at 100 * shared >= PERCENT * united shingles.
PERCENT = 75
SLICE_ROWS = 256


def _set_id(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few hundred rows at a time, so that a worker holds few shingle sets."""
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[at : at + SLICE_ROWS]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _slices(batches):
        sets = [shingle_set(text) for text in batch["text"]]
        keys = band_keys(signatures(sets)).tolist()
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "n_shingles": [len(s) for s in sets],
                "set_id": [_set_id(s) for s in sets],
                "keys": [key if len(s) else [] for key, s in zip(keys, sets, strict=True)],
            }
        )
    forget()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _slices(batches):
        sets = [shingle_set(text) for text in batch["text"]]
        same = [_set_id(s) == bytes(known) for s, known in zip(sets, batch["set_id"], strict=True)]
        rows = [(i, s.view(np.int64).tolist()) for i, s, ok in zip(batch["id"], sets, same, strict=True) if ok]
        yield pd.DataFrame(rows, columns=["id", "shingles"])
    forget()


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty("text")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _nodes(signed: DataFrame) -> DataFrame:
    """One row per distinct shingle set: its first document (smallest id, null last)."""
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("first")
    return signed.filter("n_shingles > 0").groupBy("set_id").agg(first, F.first("n_shingles").alias("n"))


def _may_link(left: str, right: str) -> Column:
    """An upper bound of the similarity from the sizes and from shingles that no other candidate has."""
    shared = F.least(F.col(f"{left}.n") - F.col(f"{left}.own"), F.col(f"{right}.n") - F.col(f"{right}.own"))
    return shared * 100 >= (F.col(f"{left}.n") + F.col(f"{right}.n") - shared) * PERCENT


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(first, "a").join(second, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    united = F.size("sa") + F.size("sb") - shared
    return both.filter(shared * 100 >= united * PERCENT).select("a", "b")


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links enough to connect what is similar, from buckets (``key``, ``id``) of candidates.

    A candidate with too many shingles of its own is similar to nothing and leaves. In each bucket
    the most typical candidate (fewest shingles of its own) is compared with all others; after
    grouping, members outside a bucket's largest group are compared with those of other groups
    that share one of their rarest shingles. So a bucket of one group of copies costs one
    comparison per member, never one per pair, and no link between different groups is lost.
    """
    each = sets.select("id", F.explode("shingles").alias("h"))
    once = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("_last")).filter("id = _last")
    own = once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("id", F.size("shingles").cast("long").alias("n"))
    nodes = sizes.join(own, "id", "left").fillna(0, ["own"])
    nodes = landed(nodes.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * PERCENT), "dup-nodes")
    members = landed(members.join(nodes, "id"), "dup-members")

    typical = F.min(F.struct((F.col("own") / F.col("n")).alias("_rate"), "id", "n", "own")).alias("p")
    pivots = members.groupBy("key").agg(typical, F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    stars = members.alias("m").join(pivots, "key").filter(F.col("m.id") != F.col("p.id")).filter(_may_link("m", "p"))
    pairs = stars.select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b")).distinct()
    pairs = landed(pairs, "dup-stars")
    links = landed(_confirmed(pairs, sets), "dup-links")

    groups = connected(links).toDF("id", "_root")
    grouped = members.join(groups, "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root")
    grouped = landed(grouped, "dup-grouped")
    sizes = grouped.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("_n", "root")).alias("_main"), F.count(F.lit(1)).alias("_groups"))
    main = main.filter("_groups > 1").select("key", F.col("_main.root").alias("main"))
    split = landed(grouped.join(main, "key"), "dup-split")
    rest = _across(split, sets)
    rest = landed(rest.join(pairs, ["a", "b"], "left_anti"), "dup-rest")
    return links.unionByName(_confirmed(rest, sets))


def _least_shared(n: Column, m: Column) -> Column:
    """The fewest shingles that sets of these sizes must share to be linked."""
    return F.ceil(((n + m) * PERCENT) / (100 + PERCENT))


def _across(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different groups of a bucket that may be linked.

    Linked sets miss only so many of each other's shingles, so they meet in the rarest ones, one
    more than either may miss (by how many sets of these buckets have a shingle). What a family
    of copies has in common is frequent and comes last, so the members of a family that are too
    far from it for a link meet few others. A pair has a member outside a bucket's main group,
    and is looked for from one side only.
    """
    least = split.groupBy("key").agg(F.min("n").alias("_least"))
    nodes = split.join(least, "key").groupBy("id", "n", "own", "root").agg(
        F.min("_least").alias("_least"), F.bool_or(F.col("root") != F.col("main")).alias("stray")
    )
    each = landed(sets.join(nodes, "id").select(*nodes.columns, F.explode("shingles").alias("h")), "dup-each")
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("_df"))
    rarest = Window.partitionBy("id").orderBy("_df", "h")
    smallest = F.greatest("_least", F.ceil(F.col("n") * PERCENT / 100))
    ranked = each.join(counts, "h").withColumn("_place", F.row_number().over(rarest))
    ranked = ranked.filter(F.col("_place") <= F.col("n") - _least_shared(F.col("n"), smallest) + 1)
    ranked = landed(ranked.select("h", "id", "n", "own", "root", "stray", "_place"), "dup-rarest")
    enough = _least_shared(F.col("u.n"), F.col("v.n"))
    near = (F.col("u._place") <= F.col("u.n") - enough + 1) & (F.col("v._place") <= F.col("v.n") - enough + 1)
    once = ~F.col("v.stray") | (F.col("u.id") < F.col("v.id"))
    apart = (F.col("u.h") == F.col("v.h")) & (F.col("u.root") != F.col("v.root")) & once & near & _may_link("u", "v")
    rows = ranked.filter("stray").alias("u").join(ranked.alias("v"), apart)
    return rows.select(F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b")).distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, ``text_hash``, ``n_shingles``, ``component_id`` and ``first`` (of its component).

    Documents whose distinct 5-word shingles are at least 75 % the same are linked; a component
    is all that links reach, named by its smallest doc_id. A text of fewer words is one shingle; null and
    empty texts have none and are linked with nothing. Rows without an id take part and come last
    in a component; repeated rows are copies. Candidates share a band of their signatures (a pair
    right at the threshold is missed with a chance of about one in a million); links are
    confirmed on full sets. Copies with equal sets meet once, so their number costs no comparisons.
    """
    schema = "doc_id string, text_hash long, n_shingles long, set_id binary, keys array<long>"
    texts = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    signed = texts.mapInPandas(_signed, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = landed(signed, "dup-signed")

    buckets = signed.select(F.explode("keys").alias("key"), "set_id")
    short = F.xxhash64("set_id")
    shared = buckets.groupBy("key").agg(F.min(short).alias("_a"), F.max(short).alias("_b")).filter("_a <> _b").select("key")
    found = landed(buckets.join(shared, "key", "left_semi").distinct(), "dup-buckets")
    nodes = landed(_nodes(signed), "dup-sets")
    candidates = nodes.join(found.select("set_id").distinct(), "set_id", "left_semi")
    candidates = numbered(candidates.select("set_id", "first"), ["first", "set_id"]).withColumnRenamed("rank", "id")
    candidates = landed(candidates, "dup-candidates")
    members = found.join(candidates.select("set_id", "id"), "set_id").select("key", "id")

    wanted = candidates.select("id", "set_id", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash"))
    # By sort and merge at any size: what few candidates let broadcast must not be the only plan tried.
    rows = _texts(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    sets = rows.select("id", "set_id", "text").mapInPandas(_sets, "id long, shingles array<long>")
    sets = landed(sets.dropDuplicates(["id"]), "dup-shingles")

    roots = connected(_links(landed(members, "dup-pairs"), sets)).toDF("id", "root")
    start = candidates.select(F.col("id").alias("root"), F.col("first").alias("component"))
    linked = roots.join(start, "root").join(candidates.select("id", "set_id"), "id").select("set_id", "component")
    component = F.coalesce("component", "first").alias("component")
    sets_to = landed(nodes.join(linked, "set_id", "left").select("set_id", component), "dup-components")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(sets_to, "set_id", "left")
    alone = F.col("set_id").isNull()
    first = F.col("component.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("component.text_hash") == F.col("text_hash"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component.doc_id")).alias("component_id"),
        (alone | first).alias("first"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the first; texts without words all stay.

    A row that repeats the first with the same id and text goes as well.
    """
    kept = landed(grouped(docs).filter("first").select("doc_id", "text_hash", F.col("n_shingles") > 0), "dup-kept")
    kept = kept.toDF("_doc", "_hash", "_worded").distinct()
    rows = docs.select(packed(docs), "doc_id", F.xxhash64(text_or_empty("text")).alias("text_hash"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    again = F.when(F.col("_worded"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    once = rows.withColumn("_again", again).dropDuplicates(["doc_id", "text_hash", "_again"])
    return once.select("row.*")
