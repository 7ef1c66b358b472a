"""The stored tables: parquet folders laid out for pruning.

Page views and events are laid out by UTC day, so a report window reads only its days. Orders
and products are versions of documents, see ``versions``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.schemas import EVENT_TIME, TABLES, conform, ddl
from shoplens.sources import folders, versions

LAYOUT: dict[str, list[str]] = {table: ["day", "load"] for table in EVENT_TIME}
_LAYOUT_TYPES = {"day": "date", "load": "string"}


#: The load of rows that batch jobs append.
BATCH = "batch"


def with_layout(df: DataFrame, table: str, load: str = BATCH) -> DataFrame:
    """The table's columns plus the ones its folders are named after.

    ``load`` names what appended the rows, so that a repeated stream batch finds its own.
    """
    out = conform(df, table)
    if table in EVENT_TIME:
        return out.withColumn("day", F.to_date(EVENT_TIME[table])).withColumn("load", F.lit(load))
    return out


def _write(df: DataFrame, path: str, table: str, mode: str, **options: str) -> None:
    cols = LAYOUT.get(table, [])
    # Rebalancing gathers each folder's rows into few files, yet splits a folder too big for one task.
    laid = df.hint("rebalance", *cols) if cols else df.hint("rebalance")
    # Sorted files let the scan skip row groups of other tenants and times.
    order = [*cols, *[c for c in ("client_id", "creation_time", "updated_at") if c in df.columns]]
    laid = laid.sortWithinPartitions(*order) if order else laid
    writer = laid.write.mode(mode).options(**options)
    (writer.partitionBy(*cols) if cols else writer).parquet(path)


def append_table(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a stored table."""
    if table in versions.KEYS:
        versions.append(df, root, table)
        return
    _write(with_layout(df, table), f"{root}/{table}", table, "append")


def append_load(df: DataFrame, root: str, table: str, load: str) -> None:
    """Append rows under a load name; the same load written again replaces itself."""
    rows = with_layout(df, table, load)
    _write(rows, f"{root}/{table}", table, "overwrite", partitionOverwriteMode="dynamic")


def keep_load(df: DataFrame, path: str, load: str | None = None) -> None:
    """Write rows to a folder of their load, which a repeated load replaces; nothing if there are none.

    Without a name the load is named after its rows, so the same rows are kept once. Equal rows
    add up in the name, and a hash skips nulls, so it takes their places as well.
    """
    rows = df.persist()
    try:
        cells = [cell for c in rows.columns for cell in (F.col(c).cast("string"), F.col(c).isNull())]
        sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")) for seed in (1, 2)]
        mark = rows.agg(F.count(F.lit(1)), *sums).first()
        if mark[0]:
            name = load or "-".join([str(mark[0]), *[f"{int(x) & (1 << 96) - 1:024x}" for x in mark[1:]]])
            rows.write.mode("overwrite").parquet(f"{path}/load={name}")
    finally:
        rows.unpersist()


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table with its layout columns; empty when it was never written."""
    if table in versions.KEYS:
        return versions.view(spark, root, table).drop(*versions.DIGESTS[table])
    path = f"{root}/{table}"
    extra = "".join(f", {c} {_LAYOUT_TYPES[c]}" for c in LAYOUT.get(table, []))
    if not folders.exists(spark, path):
        return spark.createDataFrame([], ddl(table) + extra)
    rows = spark.read.schema(ddl(table) + extra).parquet(path)
    if table in EVENT_TIME and folders.matching(spark, f"{path}/day=*/load={PACKED}*"):
        hidden, runs = _packed(spark, root, table)
        rows = rows.filter(~F.col("load").startswith(PACKED) | F.col("load").isin(runs))
        if hidden:
            rows = rows.filter(~F.concat_ws("/", F.col("day").cast("string"), "load").isin(hidden))
    return rows


#: Loads that ``pack_days`` writes are called so and numbered.
PACKED = "packed-"


def _packed(spark: SparkSession, root: str, table: str) -> tuple[list[str], list[str]]:
    """What committed packings replace, as day/load, and the loads they wrote instead."""
    done = folders.matching(spark, f"{root}/{table}_packed/run=*/_SUCCESS")
    runs = [path.rsplit("/", 2)[-2].removeprefix("run=") for path in done]
    if not runs:
        return [], []
    listed = spark.read.schema("day date, load string").parquet(*[path.rsplit("/", 1)[0] for path in done])
    # One name per load and day that was packed.
    return sorted(f"{r.day}/{r.load}" for r in listed.collect()), runs


def pack_days(spark: SparkSession, root: str, table: str, before: dt.date) -> int:
    """Rewrites the loads of streams on closed days (before a date) into sized files; how many folders it replaced.

    The new folders count once the list of what they replace is complete, so readers see each row once at
    any moment, and a failed run leaves nothing that is read. A load that a stream writes again afterwards
    stays hidden. Late loads of a packed day are packed with it the next time. Rows appended by
    batch jobs lie in sized files already and stay. ``drop_packed`` deletes what was replaced.
    """
    names = folders.matching(spark, f"{root}/{table}/day=*/load=*")
    hidden, runs = _packed(spark, root, table)
    loads: dict[str, list[str]] = {}
    for day, load in (path.split("/day=")[1].split("/load=") for path in names):
        live = load in runs if load.startswith(PACKED) else load != BATCH
        if day < str(before) and live and f"{day}/{load}" not in hidden:
            loads.setdefault(day, []).append(load)
    many = {day: own for day, own in loads.items() if len(own) > 1}
    if not many:
        return 0
    every = [path.split(PACKED)[1] for path in names if f"/load={PACKED}" in path]
    run = f"{PACKED}{max(map(int, every), default=0) + 1:06d}"
    old = [f"{day}/{load}" for day, own in many.items() for load in own]
    rows = spark.read.schema(ddl(table) + ", day date, load string").parquet(f"{root}/{table}")
    rows = rows.filter(F.concat_ws("/", F.col("day").cast("string"), "load").isin(old))
    _write(rows.withColumn("load", F.lit(run)), f"{root}/{table}", table, "append")
    replaced = spark.createDataFrame([tuple(name.split("/", 1)) for name in old], "day string, load string")
    replaced.withColumn("day", F.to_date("day")).coalesce(1).write.parquet(f"{root}/{table}_packed/run={run}")
    return len(old)


def drop_packed(spark: SparkSession, root: str, table: str) -> None:
    """Deletes the folders that packings replaced, once no reader still uses them."""
    for name in _packed(spark, root, table)[0]:
        day, load = name.split("/", 1)
        folders.drop(spark, f"{root}/{table}/day={day}/load={load}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {table: read_table(spark, root, table) for table in TABLES}


def merge_orders(
    spark: SparkSession, root: str, batch: DataFrame, named: DataFrame | None = None, whole_snapshots: bool = True
) -> None:
    """Upsert order lines into the stored orders by the rules of ``upsert_orders``, and compact them.

    For bulk corrections; a sync of feed documents only appends (``versions.sync_orders``).
    """
    key = versions.KEYS["orders"]
    one = F.struct(*[F.col(name) for name in TABLES["orders"]])
    lines = conform(batch, "orders").groupBy(*key).agg(F.collect_list(one).alias("rows"))
    names = batch.withColumn("version", F.col("updated_at")) if named is None else named
    names = names.groupBy(*key).agg(F.max("version").alias("version"))
    documents = names.filter("order_id is not null").join(lines, key, "left")
    documents = documents.withColumn("rows", F.coalesce("rows", F.array().cast(dict(lines.dtypes)["rows"])))
    versions.sync_orders(spark, root, documents, names.select("client_id") if whole_snapshots else None)
    versions.compact(spark, root, "orders")
    versions.vacuum(spark, root, "orders", keep=0)


def merge_products(spark: SparkSession, root: str, batch: DataFrame) -> None:
    """Upsert product variants into the stored products, and compact them."""
    versions.sync_products(spark, root, batch)
    versions.compact(spark, root, "products")
    versions.vacuum(spark, root, "products", keep=0)
