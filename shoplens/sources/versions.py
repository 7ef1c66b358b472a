"""Stored orders and products: a sync appends whole documents, a view takes each one's last version.

A *load* is a small folder with one row per key: the document's rows as an array, none if it is
gone. The *base* holds one version of each key, in flat rows, laid out in parts; a part has folders
per generation. A reader takes the live folders of the base without the keys that loads name,
and the last load of each key. So a sync writes its batch and nothing else, and a document,
being one row of one load, is never seen half or twice.

Compaction writes a new generation of the parts that the loads touch and then creates one marker
file. Only generations with a marker count, and the marker names the last load they hold, so that
single file switches all readers. Folders that are no longer live stay for running readers
until ``vacuum``. One writer at a time per table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.schemas import TABLES, conform, ddl
from shoplens.sources import folders

#: Folders of open checkouts, by tenant.
TENANT_FOLDERS = 64
#: A products folder is split in two when folders would hold more rows on average.
ROWS_PER_FOLDER = 500_000
#: Loads after which a sync compacts its table.
LOADS_TO_COMPACT = 256

KEYS = {"orders": ["client_id", "order_id"], "products": ["client_id", "variant_id"]}
LAYOUTS = {"orders": ["open", "part"], "products": ["bucket"]}
#: Digest columns that the base of a table keeps, to find changes without reading the rows.
DIGESTS = {"orders": [], "products": ["h1", "h2"]}
_TYPES = {"open": "boolean", "part": "string", "bucket": "int", "h1": "bigint", "h2": "bigint"}
_GEN = 10  # digits of a generation or load number in folder names

#: Metadata of the column that names the months of paid orders, which tells reports that they may prune by it.
MONTHS = {"layout": "month of updated_at"}


@dataclass(frozen=True)
class State:
    """What a table consists of at one moment."""

    base: list[str]  # live folders
    loads: list[str]  # folders of loads that the base does not hold, in order
    generation: int  # the highest in use, live or not
    sequence: int  # of the last load
    dead: list[str]  # folders that no reader of this state needs


def _number(path: str) -> int:
    return int(path.rstrip("/").rsplit("/", 1)[-1].rsplit("=", 1)[-1].split("-")[0])


def state(spark: SparkSession, root: str, table: str, keep: int = 0) -> State:
    """The table as of now; what it consisted of before one of the last ``keep`` compactions is not dead."""
    depth = "*/" * len(LAYOUTS[table])
    generations = folders.matching(spark, f"{root}/{table}/{depth}gen=*")
    loads = folders.matching(spark, f"{root}/{table}_loads/load=*")
    whole = {p.rsplit("/", 1)[0] for p in folders.matching(spark, f"{root}/{table}_loads/load=*/_SUCCESS")}
    events = []
    for marker in folders.matching(spark, f"{root}/{table}_live/*"):
        generation, kind, sequence = marker.rsplit("/", 1)[-1].split("-")
        events.append((int(generation), kind, int(sequence)))
    parts: dict[str, list[str]] = {}
    for path in generations:
        parts.setdefault(path.rsplit("/", 1)[0], []).append(path)

    def live(until: int) -> set[str]:
        """Of each part the last generation that replaced it, and what was added since."""
        kinds = {generation: kind for generation, kind, _ in events if generation <= until}
        out = set()
        for paths in parts.values():
            known = {_number(path): path for path in paths if _number(path) in kinds}
            first = max((g for g in known if kinds[g] == "replace"), default=0)
            out.update(path for g, path in known.items() if g >= first)
        return out

    def compacted(until: int) -> int:
        return max((sequence for generation, kind, sequence in events if kind == "replace" and generation <= until), default=0)

    newest = max((generation for generation, *_ in events), default=0)
    replaced = sorted(generation for generation, kind, _ in events if kind == "replace")
    moments = [newest, *[generation - 1 for generation in replaced[::-1][:keep]]]
    used = set().union(*map(live, moments))
    held = [path for path in loads if path in whole and _number(path) > compacted(newest)]
    dead = [path for path in generations if path not in used]
    dead += [path for path in loads if _number(path) <= compacted(moments[-1])]
    return State(
        sorted(live(newest)),
        held,
        max([newest, *map(_number, generations)]),
        max([compacted(newest), *map(_number, loads)]),
        dead,
    )


# --- layout ----------------------------------------------------------------------------------


def _hashed(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def tenant_part() -> Column:
    """Folder of a tenant's open checkouts."""
    return F.concat(F.lit("t"), _hashed("client_id", TENANT_FOLDERS).cast("string"))


def month_of(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def laid(rows: DataFrame, table: str, n_folders: int = 1) -> DataFrame:
    """The table's rows with the columns its folders are named after.

    Paid orders lie in folders of the UTC month of their last update, open checkouts by a hash of the tenant.
    Products lie in ``n_folders`` hashed folders, a power of two, whose numbers start at ``n_folders``:
    the numbers of different counts never meet.
    """
    if table == "orders":
        open_ = ~F.coalesce("payment_status", F.lit(False))
        month = F.coalesce(month_of(F.col("updated_at")), F.lit("none"))
        return rows.withColumn("open", open_).withColumn("part", F.when(open_, tenant_part()).otherwise(month))
    digests = {f"h{k}": F.xxhash64(F.lit(k), *_cells(rows.columns)) for k in (1, 2)}
    return rows.withColumn("bucket", _hashed("variant_id", n_folders) + n_folders).withColumns(digests)


def _cells(names: list[str]) -> list[Column]:
    """Values and the places of nulls, which a hash skips."""
    return [cell for name in names for cell in (F.col(name), F.col(name).isNull())]


def _n_folders(now: State) -> int:
    """Of a products table: the largest power of two up to any folder number."""
    numbers = [int(path.split("bucket=")[1].split("/")[0]) for path in now.base if "bucket=" in path]
    return 1 << (max(numbers).bit_length() - 1) if numbers else 1


# --- reading ---------------------------------------------------------------------------------


def _base(spark: SparkSession, root: str, table: str, now: State) -> DataFrame:
    extra = "".join(f", {c} {_TYPES[c]}" for c in [*DIGESTS[table], *LAYOUTS[table]])
    if not now.base:
        return spark.createDataFrame([], ddl(table) + extra)
    rows = spark.read.schema(f"{ddl(table)}{extra}, gen string").option("basePath", f"{root}/{table}")
    return rows.parquet(*now.base).drop("gen")


def _last(spark: SparkSession, root: str, table: str, now: State) -> DataFrame:
    """The last load of each key: the key, ``rows`` and ``digest``."""
    one = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in TABLES[table].items())}>>"
    keys = ", ".join(f"{name} {TABLES[table][name]}" for name in KEYS[table])
    loads = spark.read.schema(f"{keys}, rows {one}, load string").option("basePath", f"{root}/{table}_loads")
    return loads.parquet(*now.loads).groupBy(*KEYS[table]).agg(F.max_by("rows", "load").alias("rows"))


def _flat(documents: DataFrame, table: str, n_folders: int) -> DataFrame:
    rows = documents.select(F.explode("rows").alias("_r")).select("_r.*")
    return laid(conform(rows, table), table, n_folders)


def view(spark: SparkSession, root: str, table: str, now: State | None = None) -> DataFrame:
    """The table's rows in their last version, with the layout and digest columns; empty when never written.

    Filters on the layout columns prune the base. Loads are as many rows as were synced since the last
    compaction, so Spark may broadcast their keys; it decides by their size.
    """
    now = now or state(spark, root, table)
    rows = _base(spark, root, table, now)
    if now.loads:
        last = _last(spark, root, table, now)
        rows = rows.join(last.select(*KEYS[table]), KEYS[table], "left_anti")
        rows = rows.unionByName(_flat(last, table, _n_folders(now)))
    return rows.withMetadata("part", MONTHS) if table == "orders" else rows


# --- writing ---------------------------------------------------------------------------------


def _write_base(rows: DataFrame, root: str, table: str, generation: int) -> None:
    layout = LAYOUTS[table]
    # Rebalancing gathers each folder's rows into few files, yet splits a folder too big for one task.
    order = [c for c in ("client_id", "updated_at") if c in rows.columns]
    spread = rows.hint("rebalance", *layout).withColumn("gen", F.lit(f"{generation:0{_GEN}d}"))
    spread.sortWithinPartitions(*layout, *order).write.mode("append").partitionBy(*layout, "gen").parquet(f"{root}/{table}")


def _marker(root: str, table: str, generation: int, kind: str, sequence: int) -> str:
    return f"{root}/{table}_live/{generation:0{_GEN}d}-{kind}-{sequence:0{_GEN}d}"


def append(rows: DataFrame, root: str, table: str) -> None:
    """Adds flat rows to the base as they are, whatever is stored: a bulk load."""
    spark = rows.sparkSession
    now = state(spark, root, table)
    _write_base(laid(conform(rows, table), table, _n_folders(now)), root, table, now.generation + 1)
    folders.mark(spark, _marker(root, table, now.generation + 1, "add", now.sequence))


def dealt(documents: DataFrame, table: str) -> DataFrame:
    """The columns of a load in few tasks; by key, as without one each task sorts its whole rows to deal them out."""
    return documents.select(*KEYS[table], "rows").hint("rebalance", *KEYS[table])


def append_load(documents: DataFrame, root: str, table: str, load: str | None) -> bool:
    """Writes documents (key, ``rows``) as the next load; nothing, and False, if there are none.

    A named load that is stored already stays as it is.
    """
    spark = documents.sparkSession
    name, now = load or uuid.uuid4().hex, state(spark, root, table)
    path = f"{root}/{table}_loads/load={now.sequence + 1:0{_GEN}d}-{name}"
    few = dealt(documents, table)
    few.write.mode("errorifexists").parquet(path)
    stored = not spark.read.schema(few.schema).parquet(path).isEmpty()
    if not stored:
        folders.drop(spark, path)
    return stored


def is_stored(spark: SparkSession, root: str, table: str, load: str | None) -> bool:
    """Whether a named load is complete; what a failed attempt left of it is removed."""
    if load is None:
        return False
    found = folders.matching(spark, f"{root}/{table}_loads/load=*-{load}")
    whole = [path for path in found if folders.exists(spark, f"{path}/_SUCCESS")]
    for path in found:
        if path not in whole:
            folders.drop(spark, path)
    return bool(whole)


def compact(spark: SparkSession, root: str, table: str) -> None:
    """Moves all loads into the base: rewrites the parts they touch, then switches with one marker.

    Only the keys of the base are read to find those parts, and the parts themselves. A failure before
    the marker leaves folders that no reader sees.
    """
    now, layout, key = state(spark, root, table), LAYOUTS[table], KEYS[table]
    if not now.loads:
        return
    last = _last(spark, root, table, now).persist()
    try:
        base, n = _base(spark, root, table, now), _n_folders(now)
        if table == "products":
            total = base.count() + last.count()
            while total > n * ROWS_PER_FOLDER:
                n *= 2
        fresh = _flat(last, table, n)
        if n != _n_folders(now):
            touched = base.select(*layout).distinct()
        else:
            touched = base.join(last.select(*key), key, "left_semi").select(*layout)
            touched = touched.unionByName(fresh.select(*layout)).distinct()
        parts = [row.asDict() for row in touched.collect()]  # names of folders
        hit = F.lit(False)
        for part in parts:
            same = [F.col(name) == F.lit(value) for name, value in part.items()]
            hit = hit | (same[0] & same[1] if len(same) == 2 else same[0])
        kept = base.filter(hit).join(last.select(*key), key, "left_anti")
        kept = laid(conform(kept, table), table, n)
        generation = now.generation + 1
        _write_base(kept.unionByName(fresh), root, table, generation)
        for part in parts:  # those left without a row need an empty generation
            names = "/".join(f"{name}={str(value).lower()}" for name, value in part.items())
            folders.make(spark, f"{root}/{table}/{names}/gen={generation:0{_GEN}d}")
        folders.mark(spark, _marker(root, table, generation, "replace", _number(now.loads[-1])))
    finally:
        last.unpersist()


def vacuum(spark: SparkSession, root: str, table: str, keep: int = 1) -> None:
    """Deletes the folders that were not live after any of the last ``keep`` compactions before the newest."""
    for path in state(spark, root, table, keep).dead:
        folders.drop(spark, path)


def maintain(spark: SparkSession, root: str, table: str, loads: int = LOADS_TO_COMPACT) -> None:
    """Compacts a table with many loads, and deletes what the compaction before made superfluous."""
    if len(state(spark, root, table).loads) >= loads:
        compact(spark, root, table)
        vacuum(spark, root, table)


# --- syncs -----------------------------------------------------------------------------------


def sync_orders(
    spark: SparkSession, root: str, documents: DataFrame, snapshots: DataFrame | None = None, load: str | None = None
) -> None:
    """Stores the documents (client_id, order_id, version, ``rows``) of a feed as one load.

    A stored order that was updated after the feed's version stays, open or paid; a document without
    rows deletes its order, one without a version replaces whatever is stored. ``snapshots``
    (client_id) lists tenants whose open checkouts the feed holds completely: their stored ones
    that it does not name go. Stored versions are looked up in the open folders and in the
    months from the oldest document's on: a later version lies in no earlier month.
    """
    if is_stored(spark, root, "orders", load):
        return
    key = KEYS["orders"]
    documents = documents.persist()
    try:
        oldest = documents.agg(month_of(F.min("version"))).first()[0]
        stored = view(spark, root, "orders")
        since = F.col("part") >= F.lit(oldest) if oldest else F.lit(False)
        near = stored.filter(F.col("open") | since)
        # One row per stored order: its lines shrink before they are shuffled, and one join serves both questions.
        near = near.groupBy(*key).agg(F.max("updated_at").alias("_last"), F.bool_or("open").alias("_open"))
        given = documents.withColumn("_given", F.lit(True))
        later = F.coalesce(F.col("_last") > F.col("version"), F.lit(False))
        if snapshots is None:
            changes = given.join(near, key, "left").filter(~later).select(*key, "rows")
        else:
            tenants = snapshots.select("client_id").distinct().withColumn("_synced", F.lit(True))
            both = given.join(near, key, "full").join(tenants, "client_id", "left")
            gone = F.col("_given").isNull() & F.col("_open") & F.col("_synced")
            none = F.array().cast(dict(documents.dtypes)["rows"])
            changes = both.filter((F.col("_given") & ~later) | gone)
            changes = changes.select(*key, F.coalesce("rows", none).alias("rows"))
        append_load(changes, root, "orders", load)
    finally:
        documents.unpersist()


def sync_products(spark: SparkSession, root: str, rows: DataFrame, load: str | None = None) -> None:
    """Stores the variants that differ from what is stored as one load; none, no load.

    Of several rows of one variant the one updated last counts. Changes are found by two 64-bit
    hashes of all columns, which the base keeps, so that of the stored variants only these and the key are read.
    """
    if is_stored(spark, root, "products", load):
        return
    key, same = KEYS["products"], ["h1", "h2"]
    one = F.struct(*[F.col(name) for name in TABLES["products"]])
    last = conform(rows, "products").groupBy(*key).agg(F.max_by(one, F.struct("updated_at", one)).alias("r"))
    incoming = laid(last.select("r.*"), "products")
    stored = view(spark, root, "products").select(*key, *same)
    changed = incoming.join(stored, [*key, *same], "left_anti")
    append_load(changed.select(*key, F.array(one).alias("rows")), root, "products", load)
