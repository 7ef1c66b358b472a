import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.operators import experiments, feeds
from shoplens.schemas import FEED_PAGES, ddl
from shoplens.sources import tables
from shoplens.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event_rows(n, day=0):
    return [
        {
            "client_id": "a",
            "experiment_id": "e",
            "variation_id": "xy"[i % 2],
            "session_id": f"s{i % 7}" if i % 11 else None,
            "event_name": "clicked" if i % 3 == 0 else "served",
            "creation_time": (T0 + dt.timedelta(days=day, minutes=37 * i)).isoformat(),
        }
        for i in range(n)
    ]


@pytest.fixture()
def landing(spark, table, tmp_path):
    """A landing folder that takes one parquet file per call, and streaming reads of it."""

    class Landing:
        root = str(tmp_path / "store")
        progress = str(tmp_path / "progress")

        def put(self, name, rows):
            table(name, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

        def stream(self, name):
            return (
                spark.readStream.schema(ddl(name)).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
            )

        def batch(self, name):
            return spark.read.schema(ddl(name)).parquet(str(tmp_path / name))

    return Landing()


def test_append(spark, landing):
    for day in range(2):
        landing.put("events", event_rows(40, day))
        jobs.append_stream(landing.stream("events"), landing.root, "events", landing.progress).awaitTermination()
    stored = tables.read_table(spark, landing.root, "events")
    assert stored.count() == 80
    assert rows_of(stored.drop("day", "load")) == rows_of(landing.batch("events"))


def test_streams_and_batches_share_a_table_and_a_repeated_batch_adds_nothing(spark, landing, table):
    landing.put("events", event_rows(40))
    jobs.append_stream(landing.stream("events"), landing.root, "events", landing.progress).awaitTermination()
    tables.append_table(table("events", event_rows(10)), landing.root, "events")
    tables.append_table(table("events", event_rows(10)), landing.root, "events")
    assert tables.read_table(spark, landing.root, "events").count() == 60
    load = [r.load for r in tables.read_table(spark, landing.root, "events").select("load").distinct().collect()]
    stream_load = next(name for name in load if name != "batch")
    for _ in range(2):
        tables.append_load(landing.batch("events"), landing.root, "events", stream_load)
        assert tables.read_table(spark, landing.root, "events").count() == 60


def cookies(*triples):
    return [
        {"client_id": "a", "session_id": s, "cart_token": c, "creation_time": (T0 + dt.timedelta(hours=h)).isoformat()}
        for s, c, h in triples
    ]


def test_cookie_dedup_forever(spark, landing):
    def run():
        jobs.unique_cookie_stream(landing.stream("cookies"), landing.root, landing.progress).awaitTermination()

    landing.put("cookies", cookies(("s1", "c1", 1), ("s1", "c1", 0), ("", "c9", 0)))
    run()
    landing.put("cookies", cookies(("s1", "c1", 2), ("s1", "c2", 2)))
    landing.put("cookies", cookies(("s1", "c1", 900), ("s2", "c1", 3)))
    run()
    run()
    got = jobs.read_unique_cookies(spark, landing.root).withColumn("h", F.hour("creation_time"))
    assert rows_of(got, "session_id", "cart_token", "h") == [("s1", "c1", 0), ("s1", "c2", 2), ("s2", "c1", 3)]


@pytest.mark.parametrize("delay", ["1 day", None])
def test_cookie_dedup_within_delay(spark, landing, delay):
    landing.put("cookies", cookies(("s1", "c1", 1), ("s1", "c1", 2), ("s2", "c1", 2)))
    landing.put("cookies", cookies(("s1", "c1", 3), ("s3", "c1", 3)))
    query = jobs.dedup_cookie_stream(landing.stream("cookies"), landing.root, landing.progress, delay)
    query.awaitTermination()
    got = spark.read.parquet(landing.root)
    assert rows_of(got, "session_id", "cart_token") == [("s1", "c1"), ("s2", "c1"), ("s3", "c1")]


def test_daily_counts(spark, landing):
    for day in range(3):
        landing.put("events", event_rows(60, day))
    jobs.daily_count_stream(landing.stream("events"), landing.root, landing.progress, delay="10 days").awaitTermination()
    got = jobs.read_daily_counts(spark, landing.root)
    batch = (
        landing.batch("events")
        .groupBy(F.to_date("creation_time").alias("day"), "client_id", "experiment_id", "variation_id", "event_name")
        .agg(F.count(F.lit(1)).alias("events"))
    )
    assert rows_of(got, *batch.columns) == rows_of(batch)


def test_daily_visitors_are_exact_with_late_rows(spark, landing):
    for day in (5, 6, 0):
        landing.put("events", event_rows(60, day))
        jobs.daily_visitor_stream(landing.stream("events"), landing.root, landing.progress).awaitTermination()
    batch = experiments.event_counts(landing.batch("events").withColumn("day", F.to_date("creation_time")), "day").drop("served_rows")
    got = jobs.read_daily_visitors(spark, landing.root)
    assert rows_of(got, *batch.columns) == rows_of(batch)


@pytest.mark.parametrize("delay", ["30 days", None])
def test_new_visitors(spark, landing, delay):
    for day in (5, 6, 0, 5):
        landing.put("events", event_rows(60, day))
        jobs.new_visitor_stream(landing.stream("events"), landing.root, landing.progress, delay).awaitTermination()
    batch = (
        landing.batch("events")
        .filter("session_id is not null")
        .groupBy(F.to_date("creation_time").alias("day"), "client_id", "experiment_id", "variation_id", "event_name")
        .agg(F.count_distinct("session_id").alias("visitors"))
    )
    assert rows_of(jobs.read_new_visitors(spark, landing.root), *batch.columns) == rows_of(batch)


def test_order_and_product_sync(spark, landing, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    schema = f"client_id string, {FEED_PAGES['orders']}, {FEED_PAGES['checkouts']}, {FEED_PAGES['products']}"
    stream = lambda: spark.readStream.schema(schema).json(str(pages))

    def land(name, **feeds_of):
        (pages / name).write_text("\n".join(json.dumps({"client_id": shop.CLIENT, k: v}) for k, v in feeds_of.items()))

    def sync():
        jobs.order_sync_stream(stream(), landing.root, landing.progress + "-o", whole_snapshots=True).awaitTermination()
        jobs.product_sync_stream(stream(), landing.root, landing.progress + "-p").awaitTermination()
        return tables.read_table(spark, landing.root, "orders"), tables.read_table(spark, landing.root, "products")

    land("1.json", orders=shop.order_page(), checkouts=shop.checkout_page(), products=shop.product_page())
    orders, products = sync()
    assert (orders.count(), products.count()) == (14, 6)
    newer = [dict(shop.order_page()[0], updated_at="2020-06-05T00:00:00Z", line_items=shop.order_page()[0]["line_items"][:1])]
    land("2.json", orders=shop.order_page()[:1] + newer, checkouts=shop.checkout_page()[:1])
    orders, products = sync()
    assert orders.filter("order_id = 1").count() == 1, "the later version of a document wins"
    assert orders.filter("not payment_status").count() == 2
    assert orders.count() == 11 and products.count() == 6
    assert feeds.order_watermark(orders).count() == 1


def test_split_snapshots_and_bad_rows_are_kept(spark, landing, tmp_path):
    """One file per micro-batch: neither checkouts nor rejected rows depend on how files are split."""
    pages = tmp_path / "pages"
    pages.mkdir()
    bad = dict(shop.order_page()[0], line_items=[dict(shop.order_page()[0]["line_items"][0], price="free")])
    for name, feed in [("1", {"checkouts": shop.checkout_page()[:1]}), ("2", {"checkouts": shop.checkout_page()[1:]}), ("3", {"orders": [bad]})]:
        (pages / f"{name}.json").write_text(json.dumps({"client_id": shop.CLIENT, **feed}) + "\n{oops\n")
    schema = f"client_id string, {FEED_PAGES['orders']}, {FEED_PAGES['checkouts']}, unreadable string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("columnNameOfCorruptRecord", "unreadable")
    jobs.order_sync_stream(reader.json(str(pages)), landing.root, landing.progress).awaitTermination()
    stored = tables.read_table(spark, landing.root, "orders")
    assert rows_of(stored.select("order_id").distinct()) == [(21,), (22,)]
    rejected = spark.read.parquet(f"{landing.root}/rejected_orders")
    assert rows_of(rejected.select("order_id", F.concat_ws(",", "missing").alias("missing"))) == [(1, "variant_price")]
    assert spark.read.parquet(f"{landing.root}/rejected_pages_orders").count() == 3
