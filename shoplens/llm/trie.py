"""Prefix trie of conversations: a count-min sketch of prefix digests tells which prefixes can be shared."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import landed

GROUP, BORROWED = 100, 6
#: Cells per row of the sketch: four per prefix, within these bounds. Two rows of one byte a cell
#: go to every worker, so at most 32 MB; with more prefixes fewer are proved single, and no result changes.
MIN_CELLS, MAX_CELLS = 1 << 14, 1 << 24
SKETCH_ROWS = 2
#: Cells of a partial sketch that travel as one row.
SKETCH_BLOCK = 1 << 16
#: Characters of a text that the bounds of the ranges hold.
RANGE_CHARS = 64
#: Turns of a conversation that one window sorts.
CHUNK = 1024
#: Member ids that travel as one row.
IDS = 4096
KEY = ["depth", "x1", "x2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_SKETCH = pa.schema([("block", pa.int64()), ("cells", pa.binary())])
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# --- rebuilt conversations -------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, i from 0, two content hashes a and b, chars), and (conv_id, n) of every conversation.

    Turns are dealt by range of (conv_id, turn, role, start of the text), so that a conversation of any
    length is sorted by several tasks; its first place is found from one total per range. Texts travel once.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    ranges = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(RANGE_CHARS)))
    ranges = ranges.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.length("text").cast("long").alias("chars"),
        F.spark_partition_id().alias("range"),
        F.monotonically_increasing_id().alias("at"),
    )
    turns = landed(ranges, "trie-turns")
    # One row per range and conversation in it; a conversation spans few ranges.
    parts = turns.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = landed(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    turns = turns.join(parts.drop("n"), ["conv_id", "range"])
    turns = turns.select("conv_id", (F.col("before") + F.col("at") - F.col("low")).alias("i"), "a", "b", "chars")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, p from 0, a, b, chars) and lengths (conv_id, length) after the borrowed starts."""
    turns, convs = ordered_turns(conversations)
    turns, convs = landed(turns, "trie-numbered"), landed(convs, "trie-conversations")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    convs = convs.select("conv_id", "n", base, wanted.alias("h"))
    heads = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    plan = convs.join(heads, "base", "left").select(
        "conv_id",
        "base",
        "h",
        F.least("h", F.coalesce("base_n", F.lit(0))).alias("borrowed"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"),
    )
    plan = landed(plan, "trie-plan")
    own = turns.join(plan.select("conv_id", "h", "borrowed"), "conv_id").filter("i >= h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("borrowed")).alias("p"), "a", "b", "chars")
    starts = turns.filter((F.col("i") < BORROWED) & (F.col("conv_id") % GROUP == 0))
    starts = starts.select(F.col("conv_id").alias("base"), F.col("i").alias("p"), "a", "b", "chars")
    # Each start goes to the conversations of one hundred ids.
    taken = plan.filter("borrowed > 0").select("conv_id", "base", "borrowed").join(starts, "base").filter("p < borrowed")
    rows = own.unionByName(taken.select("conv_id", "p", "a", "b", "chars"))
    return rows, plan.select("conv_id", (F.col("borrowed") + F.col("own")).alias("length"))


def _running(rows: DataFrame, values: dict[str, Column], back: bool = False) -> DataFrame:
    """Adds aggregates over all places ``p`` of the conversation up to the row's own (from it on, with ``back``).

    Chunks of ``CHUNK`` places are sorted on their own and meet as one row each, so that no
    window holds a long conversation.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col("p") / CHUNK))
    way = F.desc if back else F.asc
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(way("p"))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside = Window.partitionBy("conv_id").orderBy(way("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "_chunk").agg(*[value.alias(f"_all_{name}") for name, value in values.items()])
    fold = F.sum if back else F.bit_xor
    chunks = chunks.select(
        "conv_id", "_chunk", *[F.coalesce(fold(f"_all_{name}").over(outside), F.lit(0)).alias(f"_far_{name}") for name in values]
    )
    rows = rows.withColumns({f"_near_{name}": value.over(inside) for name, value in values.items()})
    rows = rows.join(landed(chunks, "trie-chunks"), ["conv_id", "_chunk"])
    both = (lambda x, y: x + y) if back else (lambda x, y: x.bitwiseXOR(y))
    rows = rows.withColumns({name: both(F.col(f"_near_{name}"), F.col(f"_far_{name}")) for name in values})
    return rows.drop("_chunk", *[f"_{part}_{name}" for part in ("near", "far") for name in values])


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per conversation and depth, from 0: the 128-bit digests of the prefix and of its parent.

    A digest is the exclusive or of one hash per place, made of the place, role and text; ``chars`` is
    the length of the last text, ``last`` says whether the conversation ends here.
    """
    rows, lengths = rebuilt(conversations)
    own = {f"x{k}": F.xxhash64(F.lit(k), "p", "a", "b") for k in (1, 2)}
    rows = _running(rows, {name: F.bit_xor(value) for name, value in own.items()})
    rows = rows.join(lengths, "conv_id").select(
        "conv_id",
        (F.col("p") + 1).alias("depth"),
        "x1",
        "x2",
        *[F.col(name).bitwiseXOR(value).alias(f"up{name[1]}") for name, value in own.items()],
        "chars",
        (F.col("p") + 1 == F.col("length")).alias("last"),
    )
    none = [F.lit(0).cast("long").alias(name) for name in ("depth", "x1", "x2", "up1", "up2", "chars")]
    return rows.unionByName(lengths.select("conv_id", *none, (F.col("length") == 0).alias("last")))


# --- count-min sketch ------------------------------------------------------------------------


def cells_of(depth: np.ndarray, x1: np.ndarray, x2: np.ndarray, size: int) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch; ``size`` is a power of two."""
    key = x1.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k in range(SKETCH_ROWS):
        h = (key ^ (x2.view(np.uint64) >> np.uint64(7 * k + 1))) * _MIX[k % 2]
        out.append(((h ^ (h >> np.uint64(31))) & np.uint64(size - 1)).astype(np.int64))
    return out


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(name)).astype(np.int64, copy=False) for name in names]


def sketch(rows: DataFrame, size: int) -> np.ndarray:
    """How often each cell was hit, 2 meaning two times or more.

    Each task counts into its own sketch; blocks of it that hold anything are added up
    per block in a stream, and as many blocks as the sketch has reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH_ROWS, size), np.uint8)
        for batch in batches:
            for row, cells in zip(total, cells_of(*_numbers(batch, *KEY), size), strict=True):
                used, n = np.unique(cells, return_counts=True)
                row[used] = np.minimum(row[used] + np.minimum(n, 2), 2)
        yield from _blocks(total.reshape(-1))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), np.uint8)
                if block != at and at is not None:
                    yield _packed([(at, total)])
                total = np.minimum(total + part, 2) if block == at else part
                at = block
        if at is not None:
            yield _packed([(at, total)])

    ddl = "block long, cells binary"
    parts = rows.select(*KEY).mapInArrow(counted, ddl).repartition("block").sortWithinPartitions("block")
    out = np.zeros(SKETCH_ROWS * size, np.uint8)
    for row in parts.mapInArrow(added, ddl).toLocalIterator():
        cells = np.frombuffer(zlib.decompress(row.cells), np.uint8)
        out[row.block * SKETCH_BLOCK : row.block * SKETCH_BLOCK + len(cells)] = cells
    return out.reshape(SKETCH_ROWS, size)


def _packed(blocks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    rows = [{"block": at, "cells": zlib.compress(cells.tobytes(), 1)} for at, cells in blocks]
    return pa.RecordBatch.from_pylist(rows, _SKETCH)


def _blocks(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cells), SKETCH_BLOCK):
        block = cells[at : at + SKETCH_BLOCK]
        if block.any():
            yield _packed([(at // SKETCH_BLOCK, block)])


def screened(rows: DataFrame) -> DataFrame:
    """Adds ``single`` and ``up_single``: the sketch proves that no other conversation has the prefix (its parent).

    An estimate is never below the count, so one hit means one conversation. More hits prove nothing.
    """
    size = MIN_CELLS
    while size < min(4 * rows.count(), MAX_CELLS):
        size *= 2
    cells = rows.sparkSession.sparkContext.broadcast(sketch(rows, size))
    names = rows.columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, x1, x2, up1, up2 = _numbers(batch, *KEY, "up1", "up2")
            marks = []
            for key in ((depth, x1, x2), (np.maximum(depth - 1, 0), up1, up2)):
                hits = [row[at] for row, at in zip(cells.value, cells_of(*key, size), strict=True)]
                marks.append(pa.array(np.min(hits, axis=0) < 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*names, "single", "up_single"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(judged, f"{schema}, single boolean, up_single boolean")


# --- nodes -----------------------------------------------------------------------------------


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending member ids of each key, comma-joined.

    Ids are sorted in ranges of (key, id) and joined into rows of up to ``IDS``; a key's rows are
    then hashed in order, one after the other, in constant memory.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close() -> None:
            out.append(dict(zip(KEY, key, strict=True)) | {"first": ids[0], "ids": ",".join(map(str, ids))})

        for batch in batches:
            for *own, conv in zip(*(batch.column(name).to_pylist() for name in [*KEY, "conv_id"]), strict=True):
                if own != key or len(ids) == IDS:
                    if ids:
                        close()
                    key, ids = own, []
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(out, joined_schema)
            out.clear()
        if ids:
            close()
        yield pa.RecordBatch.from_pylist(out, joined_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(name).to_pylist() for name in [*KEY, "ids"]), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append(dict(zip(KEY, key, strict=True)) | {"ends": state.hexdigest()})
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist(out, hashed_schema)
            out.clear()
        if key is not None:
            out.append(dict(zip(KEY, key, strict=True)) | {"ends": state.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, hashed_schema)

    keys = [(name, pa.int64()) for name in KEY]
    joined_schema = pa.schema([*keys, ("first", pa.int64()), ("ids", pa.string())])
    hashed_schema = pa.schema([*keys, ("ends", pa.string())])
    ddl = ", ".join(f"{name} long" for name in KEY)
    ranges = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ranges.mapInArrow(joined, f"{ddl}, first long, ids string")
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.mapInArrow(hashed, f"{ddl}, ends string")


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: one row per distinct prefix, from the textless root.

    Every conversation starts with the first h turns of conversation ``conv_id - conv_id % 100`` (h is
    the CRC-32 of its decimal id modulo 6) in place of its own first h. Prefixes that the sketch
    proves single make nodes on the spot: one member, one leaf. All others are grouped exactly
    by depth and digest; what a node sums over its subtree (leaves and saved characters) is
    written to the smallest member of each node below, summed along that conversation from its
    end, and then over the node's members. Groups of any size are sums with partial steps; rows
    meet their group in joins of which one side has unique keys.

    Turns go by number, null first, then by role and text; a null role or text is empty; rows
    without a conv_id belong to none and are left out; repeated rows are turns of their own. No
    conversations, no root. Characters are code points.
    """
    rows = landed(screened(landed(prefixes(conversations), "trie-prefixes")), "trie-screened")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"), F.col("up2").alias("x2")]
    shared = rows.filter("not single")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    groups = shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("first"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("up1").alias("up1"),
        F.min("up2").alias("up2"),
        F.min("chars").alias("chars"),
        F.bool_and("up_single").alias("up_single"),
    )
    groups = landed(groups, "trie-groups")
    # A child is a group, or a single prefix; below a single one there is nothing to count.
    below = groups.filter("depth > 0 and not up_single").select(*up)
    below = below.unionByName(rows.filter("single and not up_single and depth > 0").select(*up))
    children = below.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    groups = groups.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    groups = landed(groups, "trie-children")

    facts = groups.select(*KEY, "first", "n_convs", "n_children")
    members = landed(shared.select(*KEY, "conv_id", "chars", "last").join(facts, KEY), "trie-members")
    owner = F.col("conv_id") == F.col("first")
    leaf = F.col("last") & owner & (F.col("n_children") == 0)
    # A prefix with a single child that is single itself: its leaf lies in the tail.
    tails = rows.filter("single and last").select(
        "conv_id", F.col("depth").alias("p"), one.alias("leaf"), zero.alias("saved"), F.lit(False).alias("grouped")
    )
    parts = members.select(
        "conv_id",
        F.col("depth").alias("p"),
        leaf.cast("long").alias("leaf"),
        F.when(owner, (F.col("n_convs") - 1) * F.col("chars")).otherwise(zero).alias("saved"),
        F.lit(True).alias("grouped"),
        "x1",
        "x2",
    )
    parts = landed(parts.unionByName(tails, allowMissingColumns=True), "trie-parts")
    summed = _running(parts, {"leaves": F.sum("leaf"), "saved_tokens": F.sum("saved")}, back=True).filter("grouped")
    sums = summed.groupBy(F.col("p").alias("depth"), "x1", "x2").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    ends = _digests(members.filter("last"))
    parents = groups.select(*[F.col(k).alias(f"of_{k}") for k in KEY], F.col("first").alias("parent"))
    meets = (
        (F.col("depth") - 1 == F.col("of_depth")) & (F.col("up1") == F.col("of_x1")) & (F.col("up2") == F.col("of_x2"))
    )
    whole = groups.join(sums, KEY, "left").join(ends, KEY, "left").join(parents, meets, "left")
    own = F.when(F.col("depth") > 0, F.coalesce("parent", "first"))
    grouped = whole.select(
        F.col("first").alias("conv_id"),
        "depth",
        own.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )

    def alone(part: DataFrame, parent: Column) -> DataFrame:
        end = F.sha2(F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256)
        return part.select(
            "conv_id",
            "depth",
            parent.alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            end.alias("ends_sha256"),
        )

    top = rows.filter("single and (up_single or depth = 0)")
    first = rows.filter("single and not up_single and depth > 0").join(parents, meets)
    tail = alone(top, F.when(F.col("depth") > 0, F.col("conv_id"))).unionByName(alone(first, F.col("parent")))
    return grouped.unionByName(tail)
