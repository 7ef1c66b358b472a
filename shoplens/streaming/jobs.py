"""Ingestion and running counts as Structured Streaming jobs.

Each job takes a streaming DataFrame, writes to a folder and keeps its progress in a
checkpoint folder. A micro-batch writes folders of its own, so a batch that runs again
replaces its own output and every row arrives exactly once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplens.functions.text import filled
from shoplens.operators.experiments import ARM
from shoplens.operators.feeds import (
    ORDER_REQUIRED,
    PRODUCT_REQUIRED,
    complete,
    named_documents,
    order_batch,
    order_documents,
    product_rows,
)
from shoplens.operators.merge import new_cookies
from shoplens.plans.sync import keep_anonymous, keep_rejected, keep_unreadable
from shoplens.schemas import conform, ddl
from shoplens.sources import versions
from shoplens.sources.tables import append_load

COOKIE_KEY = ["client_id", "session_id", "cart_token"]


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(rows: DataFrame, root: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append landed registrations to an append-only table, late rows included.

    Each micro-batch is a load of its own, named after the checkpoint it belongs to, so the
    table can take rows from streams and batch jobs alike.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        append_load(batch, root, table, _load_name(checkpoint, batch_id))

    return _start(rows.writeStream.foreachBatch(on_batch), checkpoint, once)


def dedup_cookie_stream(
    rows: DataFrame, path: str, checkpoint: str, delay: str | None = "1 day", once: bool = True
) -> StreamingQuery:
    """First cookie of each (session, cart) to arrive.

    With a delay the state holds only the keys of that long; without one every key is kept on
    the executors' disks, and no micro-batch has to read what was stored before.
    """
    known = rows.filter(filled(F.col("session_id")) & filled(F.col("cart_token")))
    if delay is None:
        first = known.dropDuplicates(COOKIE_KEY)
    else:
        first = known.withWatermark("creation_time", delay).dropDuplicatesWithinWatermark(COOKIE_KEY)
    writer = first.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, checkpoint, once)


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All micro-batch folders under a path, with ``batch_id``; empty before the first one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)


def unique_cookie_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Earliest cookie of each (session, cart) of the batch that first held it.

    Checked against what earlier batches stored, so there is no state, but each micro-batch
    reads the stored keys: for few large batches rather than many small ones.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        stored = _batches(batch.sparkSession, path, ddl("cookies")).filter(F.col("batch_id") != batch_id)
        fresh = new_cookies(stored, batch).select("client_id", "session_id", "cart_token", "creation_time")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(rows.writeStream.foreachBatch(on_batch), checkpoint, once)


def read_unique_cookies(spark: SparkSession, path: str) -> DataFrame:
    return _batches(spark, path, ddl("cookies")).drop("batch_id")


def _load_name(checkpoint: str, batch_id: int) -> str:
    return f"{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}-{batch_id}"


def order_sync_stream(
    pages: DataFrame, root: str, checkpoint: str, once: bool = True, whole_snapshots: bool = False
) -> StreamingQuery:
    """Upsert landed pages with ``orders`` and ``checkouts`` into the stored orders.

    How a source splits its files over micro-batches decides nothing: documents replace their own
    earlier versions, and later stored versions stay. Only where each micro-batch is known to hold
    all open checkouts of the tenants it names may ``whole_snapshots`` be set, and checkouts that
    it no longer names go. Incomplete rows and unreadable pages are kept as in ``sync_orders``, and
    orders without a cart get their cookies and served events. Everything a micro-batch writes bears its
    name, so one that runs again ends the same.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, load = batch.sparkSession, _load_name(checkpoint, batch_id)
        keep_rejected(order_batch(batch, batch), ORDER_REQUIRED, root, "orders", load)
        keep_unreadable(batch, root, "orders", load)
        synced = named_documents(batch, batch).select("client_id") if whole_snapshots else None
        versions.sync_orders(spark, root, order_documents(batch, batch), synced, load)
        keep_anonymous(spark, root, batch, load)
        versions.maintain(spark, root, "orders")

    return _start(pages.writeStream.foreachBatch(on_batch), checkpoint, once)


def product_sync_stream(pages: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert landed product pages into the stored products; rejects are kept as in ``sync_products``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        load, rows = _load_name(checkpoint, batch_id), product_rows(batch)
        keep_rejected(rows, PRODUCT_REQUIRED, root, "products", load)
        keep_unreadable(batch, root, "products", load)
        versions.sync_products(batch.sparkSession, root, complete(rows, PRODUCT_REQUIRED), load)
        versions.maintain(batch.sparkSession, root, "products")

    return _start(pages.writeStream.foreachBatch(on_batch), checkpoint, once)


def daily_count_stream(
    events: DataFrame, path: str, checkpoint: str, delay: str = "1 day", once: bool = True
) -> StreamingQuery:
    """Running event counts per variation and UTC day; rows later than the delay are dropped.

    Each micro-batch writes the counts that changed; ``read_daily_counts`` takes the last.
    """
    counts = (
        events.withWatermark("creation_time", delay)
        .groupBy(F.window("creation_time", "1 day").alias("w"), *ARM, "event_name")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.to_date("w.start").alias("day"), *ARM, "event_name", "events")
    )

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(counts.writeStream.outputMode("update").foreachBatch(on_batch), checkpoint, once)


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    schema = "day date, client_id string, experiment_id string, variation_id string, event_name string, events bigint"
    key = ["day", *ARM, "event_name"]
    return _batches(spark, path, schema).groupBy(*key).agg(F.max_by("events", "batch_id").alias("events"))


COUNTS = ("num_session", "num_visitor", "goal_conversion_count")
_COUNT_DDL = f"day date, client_id string, experiment_id string, variation_id string, {', '.join(f'{c} bigint' for c in COUNTS)}"
_SEEN_DDL = "client_id string, experiment_id string, variation_id string, session_id string, served boolean, clicked boolean, day date"


def daily_visitor_stream(events: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running distinct visitors per variation and UTC day, exact for late rows too.

    A micro-batch is reduced to one row per session and day, meets the sessions seen before on its
    days, and writes what it adds: the counts' increments and the sessions that are new, or newly
    served or clicked. Neither events nor counts are read again; of the seen sessions only those days are.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, ["day", *ARM, "session_id"]
        named = F.col("event_name")
        now = (
            conform(batch, "events")
            .filter(named.isin("served", "clicked"))
            .groupBy(F.to_date("creation_time").alias("day"), *ARM, "session_id")
            .agg(F.count_if(named == "served").alias("n_served"), F.count_if(named == "clicked").alias("n_clicked"))
            .persist()
        )
        # Calendar days of one micro-batch, as literals so that only their folders are read.
        days = [r.day for r in now.select("day").distinct().toLocalIterator()]
        seen = _batches(spark, f"{root}/seen_sessions", _SEEN_DDL).filter(F.col("batch_id") != batch_id)
        seen = seen.filter(F.col("day").isin(days)).groupBy(*key)
        seen = seen.agg(F.bool_or("served").alias("was_served"), F.bool_or("clicked").alias("was_clicked"))
        both = now.join(seen, key, "left")
        fresh = {
            name: F.col("session_id").isNotNull() & (F.col(f"n_{name}") > 0) & ~F.coalesce(f"was_{name}", F.lit(False))
            for name in ("served", "clicked")
        }
        known = both.select(*key, *[mark.alias(name) for name, mark in fresh.items()], "n_served").persist()
        added = known.groupBy("day", *ARM).agg(
            F.sum(F.when(F.col("session_id").isNotNull(), F.col("n_served")).otherwise(0)).alias("num_session"),
            F.count_if("served").alias("num_visitor"),
            F.count_if("clicked").alias("goal_conversion_count"),
        )
        added.write.mode("overwrite").parquet(f"{root}/visitor_counts/batch_id={batch_id}")
        new = known.filter("served or clicked").drop("n_served").hint("rebalance", "day")
        new.write.mode("overwrite").partitionBy("day").parquet(f"{root}/seen_sessions/batch_id={batch_id}")
        known.unpersist()
        now.unpersist()

    return _start(events.writeStream.foreachBatch(on_batch), checkpoint, once)


def read_daily_visitors(spark: SparkSession, root: str) -> DataFrame:
    """The sums of all increments."""
    rows = _batches(spark, f"{root}/visitor_counts", _COUNT_DDL)
    return rows.groupBy("day", *ARM).agg(*[F.sum(c).alias(c) for c in COUNTS])


def late_row_stream(
    events: DataFrame, root: str, checkpoint: str, delay: str = "1 day", once: bool = True
) -> StreamingQuery:
    """Event counts per variation and UTC day, with rows behind the watermark in a table of their own.

    The watermark of a micro-batch is the last event time of all earlier ones less the delay, and a
    row is late if its day had ended by then. Late rows go to ``late_events``; the counts of both
    sorts are written as increments, so that a late row restates its day without reading it again.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = conform(batch, "events").withColumn("day", F.to_date("creation_time")).persist()
        times = _batches(spark, f"{root}/last_times", "last timestamp").filter(F.col("batch_id") < batch_id)
        mark = times.agg((F.max("last") - F.expr(f"interval {delay}")).alias("mark"))
        # One value; null before the second micro-batch, when nothing is late.
        late = F.coalesce(F.col("day").cast("timestamp") + F.expr("interval 1 day") <= mark.scalar(), F.lit(False))
        marked = rows.withColumn("late", late).persist()
        marked.filter("late").drop("late", "day").write.mode("overwrite").parquet(f"{root}/late_events/batch_id={batch_id}")
        counts = marked.groupBy("day", *ARM, "event_name").agg(
            F.count_if(~F.col("late")).alias("events"), F.count_if("late").alias("late_events")
        )
        counts.write.mode("overwrite").parquet(f"{root}/daily_counts/batch_id={batch_id}")
        last = rows.agg(F.max("creation_time").alias("last"))
        last.write.mode("overwrite").parquet(f"{root}/last_times/batch_id={batch_id}")
        marked.unpersist()
        rows.unpersist()

    return _start(events.writeStream.foreachBatch(on_batch), checkpoint, once)


def read_late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came too late, with the micro-batch that brought them."""
    return _batches(spark, f"{root}/late_events", ddl("events"))


def read_restated_counts(spark: SparkSession, root: str) -> DataFrame:
    """Per day what was counted in time, what came late and the restated count."""
    schema = "day date, client_id string, experiment_id string, variation_id string, event_name string, events bigint, late_events bigint"
    sums = _batches(spark, f"{root}/daily_counts", schema).groupBy("day", *ARM, "event_name")
    sums = sums.agg(F.sum("events").alias("events"), F.sum("late_events").alias("late_events"))
    return sums.withColumn("restated", F.col("events") + F.col("late_events"))


def new_visitor_stream(
    events: DataFrame, path: str, checkpoint: str, delay: str | None = None, once: bool = True
) -> StreamingQuery:
    """Distinct visitors per variation, event and UTC day, counted as they first appear.

    The state drops a session seen before on that day; each micro-batch adds only its new
    ones, so no day is read again. ``delay`` bounds the state and drops later rows.
    """
    key = ["day", *ARM, "event_name", "session_id"]
    known = events.filter(F.col("session_id").isNotNull()).withColumn("day", F.to_date("creation_time"))
    if delay is None:
        first = known.dropDuplicates(key)
    else:
        first = known.withWatermark("creation_time", delay).dropDuplicatesWithinWatermark(key)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy("day", *ARM, "event_name").agg(F.count(F.lit(1)).alias("visitors"))
        added.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(first.writeStream.foreachBatch(on_batch), checkpoint, once)


def read_new_visitors(spark: SparkSession, path: str) -> DataFrame:
    schema = "day date, client_id string, experiment_id string, variation_id string, event_name string, visitors bigint"
    return _batches(spark, path, schema).groupBy("day", *ARM, "event_name").agg(F.sum("visitors").alias("visitors"))
