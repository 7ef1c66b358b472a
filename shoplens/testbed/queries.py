"""Every operator and report, run over the shop tables derived from the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions import timeutil as tu
from shoplens.functions.timeutil import RecentDays, ReportWindow
from shoplens.operators import dims, experiments, feeds, lookups, merge, sales, traffic
from shoplens.plans import funnel, landing, product, summary, variation, visitor
from shoplens.schemas import ddl
from shoplens.session import shared_dir
from shoplens.sources import documents, tables, versions
from shoplens.streaming import jobs
from shoplens.testbed.views import DRIVER_TABLES, Testbed, order_seconds, order_time

WINDOW = ReportWindow("2024-01-03T00-00-00", "2024-01-28T23-59-59")
DAYS = RecentDays(dt.datetime(2024, 1, 15, 7, 30))
SNAPSHOT = "2024-01-15 00:00:00"

Query = Callable[[Testbed], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REGISTRY[name](Testbed(spark, sf_dir))


def moment(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text and decimals as doubles, for comparison across engines."""
    out = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        col = F.col(field.name)
        if kind == "timestamp":
            col = moment(col)
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("decimal"):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)


# --- feeds, ingestion and merges -------------------------------------------------------------


@query
def order_feed_flatten(t: Testbed) -> DataFrame:
    rows = feeds.order_batch(
        documents.parse_pages(t.order_pages(), "orders"), documents.parse_pages(t.checkout_pages(), "checkouts")
    )
    return shown(feeds.complete(rows, feeds.ORDER_REQUIRED))


@query
def checkout_feed_flatten(t: Testbed) -> DataFrame:
    return shown(feeds.checkout_rows(documents.parse_pages(t.checkout_pages(), "checkouts")))


@query
def product_feed_flatten(t: Testbed) -> DataFrame:
    return shown(feeds.product_rows(documents.parse_pages(t.product_pages(), "products")))


@query
def order_watermark(t: Testbed) -> DataFrame:
    return shown(feeds.order_watermark(t.orders))


@query
def product_watermark(t: Testbed) -> DataFrame:
    return shown(feeds.product_watermark(t.products))


@query
def incremental_orders(t: Testbed) -> DataFrame:
    stored = t.orders.filter(F.col("updated_at") < F.to_timestamp(F.lit(SNAPSHOT)))
    rows = feeds.order_rows(documents.parse_pages(t.order_pages(), "orders"))
    return shown(feeds.since(rows, feeds.order_watermark(stored)))


def _sync_pages(docs: Callable[[str], DataFrame]) -> DataFrame:
    """Feed pages of one sync: finished orders as orders, open ones as checkouts.

    Orders that are neither are not in the feed, so that stored orders have to survive the sync.
    Some of the documents have no lines left.
    """
    paid = docs("orders").filter(F.col("o_orderstatus") == "F").select("client_id", "orders")
    still_open = docs("checkouts").filter(F.col("o_orderstatus") == "P").select("client_id", "checkouts")
    return paid.unionByName(still_open, allowMissingColumns=True)


@query
def order_upsert(t: Testbed) -> DataFrame:
    pages = _sync_pages(t.order_documents)
    named = feeds.named_documents(pages, pages)
    return shown(merge.upsert_orders(t.orders, feeds.order_batch(pages, pages), named))


def _late(docs: Callable[[str], DataFrame], entries: str, days: int, share: int) -> DataFrame:
    """Documents of which every ``share``-th order comes in a version that is some days older."""
    key = F.col("o_orderkey")
    older = F.date_format(order_time("o_orderkey") - F.expr(f"interval {days} days"), "yyyy-MM-dd'T'HH:mm:ssxxx")
    aged = lambda d: F.when(key % share == 0, d.withField("updated_at", older)).otherwise(d)
    return docs(entries).withColumn(entries, F.transform(entries, aged))


def _stale_pages(docs: Callable[[str], DataFrame]) -> DataFrame:
    """Pages of a sync that names some orders in older versions and leaves out some open ones."""
    key = F.col("o_orderkey")
    paid = _late(docs, "orders", 1, 3).filter("o_orderstatus = 'F'").select("client_id", "orders")
    still_open = _late(docs, "checkouts", 1, 3).filter((F.col("o_orderstatus") == "P") & (key % 7 != 1))
    return paid.unionByName(still_open.select("client_id", "checkouts"), allowMissingColumns=True)


@query
def order_upsert_stale(t: Testbed) -> DataFrame:
    """Stored orders that are newer than the feed's versions stay, open and paid ones."""
    pages = _stale_pages(t.order_documents)
    named = feeds.named_documents(pages, pages)
    return shown(merge.upsert_orders(t.orders, feeds.order_batch(pages, pages), named))


@query
def order_upsert_stored(t: Testbed) -> DataFrame:
    """Several syncs into the stored orders, compacted in between: some paid orders, then the others with all
    open ones, then old versions without lines, then the second sync once more."""
    root = shared_dir(t.spark, "stored-orders")
    tables.append_table(t.orders, root, "orders")
    pages = _sync_pages(t.order_documents)
    number = F.coalesce(F.col("orders")[0]["id"], F.lit(1))
    emptied = _late(t.order_documents, "orders", 40, 1).filter("o_orderstatus = 'F'")
    emptied = emptied.withColumn("orders", F.transform("orders", lambda d: d.withField("line_items", F.slice(d["line_items"], 1, 0))))
    none = pages.limit(0)
    second = pages.filter(number % 2 == 1)
    for number_of_sync, (batch, whole) in enumerate([(pages.filter(number % 2 == 0), False), (second, True), (emptied, False), (second, True)]):
        documents_ = feeds.order_documents(batch, batch if whole else none)
        snapshots = feeds.named_documents(batch, batch).select("client_id") if whole else None
        versions.sync_orders(t.spark, root, documents_, snapshots)
        if number_of_sync == 1:
            versions.compact(t.spark, root, "orders")
            versions.vacuum(t.spark, root, "orders")
    return shown(tables.read_table(t.spark, root, "orders").drop("open", "part"))


@query
def product_upsert_stored(t: Testbed) -> DataFrame:
    """The product feed synced three times into the stored products, compacted after the first."""
    root = shared_dir(t.spark, "stored-products")
    tables.append_table(t.products, root, "products")
    batch = feeds.product_rows(documents.parse_pages(t.product_pages(), "products"))
    for _ in range(3):
        versions.sync_products(t.spark, root, batch)
        versions.compact(t.spark, root, "products")
    return shown(tables.read_table(t.spark, root, "products").drop("bucket"))


@query
def rejected_orders(t: Testbed) -> DataFrame:
    """Order lines set aside, from pages in which some quantities are no numbers."""
    spoilt = F.replace("body", F.lit('"quantity":"2"'), F.lit('"quantity":"some"'))
    pages = documents.parse_pages(t.order_pages().withColumn("body", spoilt), "orders")
    rows = feeds.rejected(feeds.order_rows(pages), feeds.ORDER_REQUIRED)
    return rows.select("client_id", "order_id", "variant_id", F.concat_ws(",", "missing").alias("missing"))


@query
def unreadable_pages(t: Testbed) -> DataFrame:
    """The text of order pages that break off in the middle."""
    pages = t.order_pages().withColumn("body", F.expr("CASE WHEN client_id = 'c1' THEN left(body, 20) ELSE body END"))
    return documents.unreadable_pages(documents.parse_pages(pages, "orders"))


@query
def product_upsert(t: Testbed) -> DataFrame:
    batch = feeds.product_rows(documents.parse_pages(t.product_pages(), "products"))
    return shown(merge.upsert_products(t.products, batch))


def _registrations(t: Testbed) -> DataFrame:
    return t.events.withColumn("creation_time", F.unix_seconds("creation_time"))


@query
def event_ingest(t: Testbed) -> DataFrame:
    return shown(dims.append_rows(_registrations(t), "events"))


@query
def visit_ingest(t: Testbed) -> DataFrame:
    raw = t.visits.withColumn("creation_time", F.unix_seconds("creation_time"))
    return shown(dims.append_rows(raw, "visits"))


@query
def visitor_ingest(t: Testbed) -> DataFrame:
    """Every visitor is registered twice, and both rows stay."""
    raw = t.visitors.withColumn("creation_time", F.unix_seconds("creation_time"))
    kept = ["client_id", "session_id", "region", "device", "browser", "os", "creation_time"]
    return shown(dims.append_rows(raw.unionByName(raw), "visitors").select(*kept))


def _appended(t: Testbed, rows: DataFrame, table: str) -> DataFrame:
    """Rows appended twice to a stored table and read back."""
    root = shared_dir(t.spark, f"appended-{table}")
    for _ in range(2):
        tables.append_table(rows, root, table)
    return shown(tables.read_table(t.spark, root, table).drop("day", "load"))


@query
def visit_append(t: Testbed) -> DataFrame:
    raw = t.visits.withColumn("creation_time", F.unix_seconds("creation_time"))
    return _appended(t, dims.append_rows(raw, "visits"), "visits")


@query
def visitor_append(t: Testbed) -> DataFrame:
    raw = t.visitors.withColumn("creation_time", F.unix_seconds("creation_time"))
    kept = ["client_id", "session_id", "region", "device", "browser", "os", "creation_time"]
    return _appended(t, dims.append_rows(raw, "visitors"), "visitors").select(*kept)


@query
def cookie_dedup(t: Testbed) -> DataFrame:
    return shown(merge.new_cookies(t.cookies, dims.append_rows(t.cookie_registrations(), "cookies")))


def _cart_served(t: Testbed) -> DataFrame:
    return t.cookies.select(
        F.lit("v0").alias("variation_id"),
        "client_id",
        F.lit("e1").alias("experiment_id"),
        "session_id",
        F.lit("served").alias("event_name"),
        "creation_time",
    )


@query
def event_insert_if_absent(t: Testbed) -> DataFrame:
    return shown(merge.new_events(t.events, _cart_served(t)))


@query
def anonymous_cart(t: Testbed) -> DataFrame:
    return shown(feeds.anonymous_carts(documents.parse_pages(t.order_pages(), "orders")))


@query
def anonymous_served_backfill(t: Testbed) -> DataFrame:
    carts = feeds.anonymous_carts(documents.parse_pages(t.order_pages(), "orders"))
    sessions = carts.select("client_id", "session_id", "creation_time")
    return shown(merge.serve_latest(sessions, t.experiments, t.events, t.variations))


@query
def dim_load(t: Testbed) -> DataFrame:
    """Experiments created from the tenants' sign-up data, with keys from their natural columns."""
    raw = t.raw("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id"),
        F.col("c_name").alias("experiment_name"),
        F.col("c_mktsegment").alias("page_type"),
        F.lit("split").alias("experiment_type"),
        F.lit("active").alias("status"),
        order_seconds("c_custkey").alias("creation_time"),
        order_seconds("c_custkey").alias("last_updation_time"),
    )
    return shown(dims.new_experiments(raw))


@query
def client_create(t: Testbed) -> DataFrame:
    """Tenants from sign-ups, whose other columns (a password among them) are left out."""
    raw = t.raw("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("company_name"),
        (F.col("c_acctbal") < 0).alias("disabled"),
        F.concat(F.lit("https://shop-"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("shopify_app_eg_url"),
        F.lit("UTC").alias("client_timezone"),
        F.lit("secret").alias("hashed_password"),
        order_seconds("c_custkey").alias("creation_timestamp"),
    )
    return shown(dims.new_clients(raw))


@query
def variation_create(t: Testbed) -> DataFrame:
    """Two new arms for each tenant's experiment, with keys from their natural columns."""
    arms = F.inline(F.array(*[F.struct(F.lit(n).alias("variation_name"), F.lit(s).alias("traffic_percentage")) for n, s in (("Red", 60), ("Blue", 40))]))
    raw = t.raw("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id"), F.lit("e1").alias("experiment_id"), arms
    )
    return dims.new_variations(raw)


@query
def json_roundtrip(t: Testbed) -> DataFrame:
    """Order pages written as JSON documents, read back and flattened."""
    path = shared_dir(t.spark, "landing-orders")
    documents.write_json(t.order_documents("orders").select("client_id", "orders"), path)
    return shown(feeds.order_rows(documents.read_feed(t.spark, path, "orders")))


@query
def list_files(t: Testbed) -> DataFrame:
    return documents.list_files(t.spark, t.sf_dir, prefix="l").select("name", "length")


# --- projections, lookups and windows --------------------------------------------------------


@query
def visits_window(t: Testbed) -> DataFrame:
    return shown(traffic.visits_in(t.visits, t.clients, WINDOW))


@query
def client_list(t: Testbed) -> DataFrame:
    return lookups.client_details(t.clients)


@query
def experiment_list(t: Testbed) -> DataFrame:
    return lookups.experiment_list(t.experiments)


@query
def variation_list(t: Testbed) -> DataFrame:
    return lookups.variation_list(t.variations)


@query
def latest_experiment(t: Testbed) -> DataFrame:
    return lookups.latest_experiment(t.experiments)


@query
def union_distinct(t: Testbed) -> DataFrame:
    """Sessions known from page views or from cookies."""
    return lookups.tagged_union(t.visits.select("client_id", "session_id"), t.cookies.select("client_id", "session_id"))


@query
def time_formats(t: Testbed) -> DataFrame:
    ts = F.col("ts")
    second = tu.epoch_to_time(F.unix_seconds(ts))
    bound = F.date_format(ts, tu.REPORT_BOUND)
    offset_text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))
    return t.raw("events").select(
        "event_id",
        tu.iso_utc(second).alias("iso"),
        tu.experiment_date_text(ts).alias("experiment_date"),
        tu.local_date_text(ts, "Asia/Kolkata").alias("local_date"),
        tu.short_day(tu.local_day(ts, "America/New_York")).alias("short_day"),
        moment(tu.report_bound(bound, "Asia/Kolkata")).alias("bound_utc"),
        moment(tu.dashboard_date(F.date_format(ts, "yyyy-MM-dd"), "America/New_York")).alias("day_start_utc"),
        tu.iso_to_epoch(offset_text).alias("epoch"),
    )


@query
def day_grid(t: Testbed) -> DataFrame:
    return shown(DAYS.grid(t.clients))


@query
def day_variation_grid(t: Testbed) -> DataFrame:
    return shown(variation.day_variation_grid(t.variations, t.clients, DAYS))


# --- traffic, landing pages and products -----------------------------------------------------


@query
def shop_funnel(t: Testbed) -> DataFrame:
    return funnel.shop_funnel(t.visits, t.orders, t.clients, WINDOW)


@query
def shop_funnel_union(t: Testbed) -> DataFrame:
    return funnel.shop_funnel_union(t.visits, t.orders, t.clients, WINDOW)


@query
def funnel_churn(t: Testbed) -> DataFrame:
    return funnel.funnel_churn(t.visits, t.orders, t.clients, WINDOW)


@query
def landing_first_touch(t: Testbed) -> DataFrame:
    return shown(traffic.first_touch(traffic.visits_in(t.visits, t.clients, WINDOW)))


@query
def landing_orders(t: Testbed) -> DataFrame:
    return sales.landing_orders(WINDOW.restrict(t.orders, "updated_at", t.clients))


@query
def landing_page_conversion(t: Testbed) -> DataFrame:
    return landing.landing_page_conversion(t.visits, t.orders, t.clients, WINDOW)


@query
def landing_worst(t: Testbed) -> DataFrame:
    return landing.landing_worst(t.visits, t.orders, t.clients, WINDOW)


@query
def product_visits(t: Testbed) -> DataFrame:
    return traffic.product_visits(traffic.visits_in(t.visits, t.clients, WINDOW))


@query
def product_orders(t: Testbed) -> DataFrame:
    return sales.product_orders(WINDOW.restrict(t.orders, "updated_at", t.clients))


@query
def product_dim(t: Testbed) -> DataFrame:
    return product.product_dim(t.products)


@query
def product_tags(t: Testbed) -> DataFrame:
    return product.product_tags(t.products)


@query
def product_conversion(t: Testbed) -> DataFrame:
    return product.product_conversion(t.products, t.visits, t.orders, t.clients, WINDOW)


@query
def product_conversion_by_tag(t: Testbed) -> DataFrame:
    return product.product_conversion_by_tag(t.products, t.visits, t.orders, t.clients, WINDOW)


@query
def product_worst_by_tag(t: Testbed) -> DataFrame:
    return product.product_worst_by_tag(t.products, t.visits, t.orders, t.clients, WINDOW)


# --- experiments -----------------------------------------------------------------------------


@query
def variation_event_counts(t: Testbed) -> DataFrame:
    return experiments.variation_event_counts(t.events)


@query
def events_by_day(t: Testbed) -> DataFrame:
    return shown(variation.events_by_day(t.events, t.clients, DAYS))


@query
def sales_by_day(t: Testbed) -> DataFrame:
    return shown(variation.daily_sales(t.orders, t.cookies, t.events, t.clients, DAYS))


@query
def conversion_over_time(t: Testbed) -> DataFrame:
    return shown(_over_time(t))


def _over_time(t: Testbed) -> DataFrame:
    return variation.conversion_over_time(t.variations, t.clients, t.events, t.orders, t.cookies, DAYS)


@query
def conversion_series(t: Testbed) -> DataFrame:
    series = variation.conversion_series(_over_time(t))
    lists = ["date", *variation.SERIES]
    key = [c for c in series.columns if c not in lists]
    return series.select(*key, *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in lists])


@query
def attributed_sales(t: Testbed) -> DataFrame:
    starts = lookups.experiment_start(t.experiments)
    return shown(sales.attributed_sales(t.orders, t.cookies, t.events, starts))


@query
def conversion_table(t: Testbed) -> DataFrame:
    return variation.conversion_table(t.variations, t.experiments, t.events, t.orders, t.cookies)


@query
def experiment_span(t: Testbed) -> DataFrame:
    return shown(experiments.experiment_span(t.experiments, t.events))


@query
def ab_evaluation(t: Testbed) -> DataFrame:
    rounded = ["best_rate", "chi_square_sum", "confidence", "betterness"]
    ev = summary.ab_evaluation(variation.goal_table(t.variations, t.events))
    return ev.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in ev.columns])


@query
def experiment_summary(t: Testbed) -> DataFrame:
    return summary.experiment_summary(t.experiments, t.events, variation.goal_table(t.variations, t.events))


@query
def summary_text(t: Testbed) -> DataFrame:
    return summary.summary_text(experiment_summary(t))


def _requests(t: Testbed) -> DataFrame:
    """One request of the latest experiment per session seen in the clicks or carts."""
    sessions = t.visits.select("client_id", "session_id", "creation_time").unionByName(
        t.cookies.select("client_id", "session_id", "creation_time")
    )
    return (
        sessions.groupBy("client_id", "session_id")
        .agg(F.min("creation_time").alias("creation_time"))
        .withColumn("experiment_id", F.lit("e1"))
    )


@query
def sticky_assignment(t: Testbed) -> DataFrame:
    return shown(experiments.assign(_requests(t), t.events, t.variations))


@query
def served_log(t: Testbed) -> DataFrame:
    return shown(experiments.served_events(_requests(t), t.events, t.variations))


@query
def cookie_registration(t: Testbed) -> DataFrame:
    incoming = merge.new_cookies(t.cookies, dims.append_rows(t.cookie_registrations(), "cookies"))
    return shown(merge.cookie_events(incoming, t.experiments, t.events, t.variations))


# --- visitors --------------------------------------------------------------------------------


@query
def order_sessions(t: Testbed) -> DataFrame:
    return sales.order_sessions(t.orders, t.cookies)


@query
def order_totals(t: Testbed) -> DataFrame:
    return shown(sales.order_totals(t.orders, t.cookies))


def _joined(t: Testbed) -> DataFrame:
    return visitor.visitor_orders(t.visitors, t.orders, t.cookies, t.clients, WINDOW)


@query
def visitor_orders(t: Testbed) -> DataFrame:
    return shown(_joined(t))


@query
def sales_by_dimension(t: Testbed) -> DataFrame:
    return visitor.sales_by_dimension(_joined(t))


@query
def sales_by_region(t: Testbed) -> DataFrame:
    return visitor.sales_by_region(_joined(t), t.regions).drop("geometry")


@query
def visitor_orders_null_sessions(t: Testbed) -> DataFrame:
    """Visitors of one device class have no session, as have orders without a known cart; they meet."""
    visitors = t.visitors.withColumn("session_id", F.when(F.col("device") != "d0", F.col("session_id")))
    return shown(visitor.visitor_orders(visitors, t.orders, t.cookies, t.clients, WINDOW, match_null_sessions=True))


@query
def region_feature_collection(t: Testbed) -> DataFrame:
    """Sales by region with geometry from a stored document, written as one collection per tenant and read back."""
    reference, path = shared_dir(t.spark, "regions"), shared_dir(t.spark, "collections")
    key = F.col("id").cast("int")
    corners = [F.array(key + x, key * 0 + y) for x, y in ((0, 0), (1, 0), (0, 1), (0, 0))]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*corners)).alias("coordinates"))
    region = F.struct("type", "id", "region_name", shape.alias("geometry"))
    line = F.concat(F.when(key == 0, "[\n").otherwise(",\n"), F.replace(F.to_json(region), F.lit(','), F.lit(',\n')))
    document = t.regions.select(key.alias("n"), line.alias("value")).unionByName(t.regions.filter("id = '0'").select(F.lit(10**6).alias("n"), F.lit("]").alias("value")))
    document.repartition(1).sortWithinPartitions("n").select("value").write.text(reference)
    by_region = visitor.sales_by_region(_joined(t), documents.read_regions(t.spark, reference))
    visitor.write_feature_collections(visitor.region_features(by_region), path)
    found = visitor.read_feature_collections(t.spark, path)
    geometry = F.replace("geometry", F.lit("\n"), F.lit("")).alias("geometry")
    return found.select("client_id", "document", "type", "id", geometry, "properties.*")


# --- streams ---------------------------------------------------------------------------------


class StreamingTestbed(Testbed):
    """The same views over streaming reads of the driver tables."""

    def raw(self, name: str) -> DataFrame:
        # As a pattern the path may be one file or a folder of files.
        return self.spark.readStream.schema(DRIVER_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet*")


def _stream(t: Testbed) -> tuple[StreamingTestbed, str, str]:
    return StreamingTestbed(t.spark, t.sf_dir), shared_dir(t.spark, "stream"), shared_dir(t.spark, "progress")


@query
def stream_event_ingest(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    jobs.append_stream(live.events, root, "events", progress).awaitTermination()
    return shown(tables.read_table(t.spark, root, "events").drop("day", "load"))


@query
def stream_visit_ingest(t: Testbed) -> DataFrame:
    """Page views of a stream in several micro-batches; the closed days are packed into one folder each."""
    live, root, progress = _stream(t)
    for k in range(3):
        part = live.visits.filter(F.minute("creation_time") % 3 == k)
        jobs.append_stream(part, root, "visits", f"{progress}-{k}").awaitTermination()
    tables.pack_days(t.spark, root, "visits", dt.date(2024, 1, 16))
    tables.drop_packed(t.spark, root, "visits")
    return shown(tables.read_table(t.spark, root, "visits").drop("day", "load"))


@query
def stream_visitor_ingest(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    kept = ["client_id", "session_id", "device", "browser", "os", "creation_time"]
    clicks = live.clicks.filter(F.col("event_type").isin("view", "signup"))
    rows = clicks.select(
        "client_id",
        "session_id",
        *[F.concat(F.lit(name[0]), (F.col("user_id") % n).cast("string")).alias(name) for name, n in (("device", 3), ("browser", 4), ("os", 5))],
        F.col("ts").alias("creation_time"),
    )
    jobs.append_stream(rows, root, "visitors", progress).awaitTermination()
    return shown(tables.read_table(t.spark, root, "visitors").select(*kept))


@query
def stream_cookie_watermark(t: Testbed) -> DataFrame:
    """Cookies deduplicated within a delay that spans the whole stream; which of equal keys comes first is open."""
    live, root, progress = _stream(t)
    rows = dims.append_rows(live.cookie_registrations(), "cookies")
    jobs.dedup_cookie_stream(rows, root, progress, "90 days").awaitTermination()
    return t.spark.read.parquet(root).select("client_id", "session_id", "cart_token")


@query
def stream_anonymous_carts(t: Testbed) -> DataFrame:
    """Orders without a cart in a stream: their cookies, joined with the events served to their sessions."""
    live, root, progress = _stream(t)
    for name in ("experiments", "variations", "events", "cookies"):
        tables.append_table(getattr(t, name), root, name)
    pages = documents.parse_pages(live.order_pages(), "orders")
    pages = pages.withColumn("checkouts", F.lit(None).cast(dict(pages.dtypes)["orders"]))
    jobs.order_sync_stream(pages, root, progress).awaitTermination()
    added = lambda name: tables.read_table(t.spark, root, name).filter(F.col("load") != tables.BATCH)
    served = added("events").select("client_id", "session_id", "experiment_id", "variation_id", "event_name", F.col("creation_time").alias("served_at"))
    return shown(added("cookies").drop("day", "load").join(served, ["client_id", "session_id"], "full"))


@query
def stream_order_upsert_stale(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    tables.append_table(t.orders, root, "orders")
    jobs.order_sync_stream(_stale_pages(live.order_documents), root, progress, whole_snapshots=True).awaitTermination()
    return shown(tables.read_table(t.spark, root, "orders").drop("open", "part"))


@query
def stream_cookie_dedup(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    rows = dims.append_rows(live.cookie_registrations(), "cookies")
    jobs.unique_cookie_stream(rows, root, progress).awaitTermination()
    return shown(jobs.read_unique_cookies(t.spark, root))


@query
def stream_order_upsert(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    tables.append_table(t.orders, root, "orders")
    jobs.order_sync_stream(
        _sync_pages(live.order_documents), root, progress, whole_snapshots=True
    ).awaitTermination()
    return shown(tables.read_table(t.spark, root, "orders").drop("open", "part"))


@query
def stream_order_upsert_split(t: Testbed) -> DataFrame:
    """Orders and checkouts of one sync in different micro-batches: neither drops what the other brought."""
    live, root, progress = _stream(t)
    tables.append_table(t.orders, root, "orders")
    pages = _sync_pages(live.order_documents)
    for entries in ("orders", "checkouts"):
        jobs.order_sync_stream(pages.filter(F.col(entries).isNotNull()), root, f"{progress}-{entries}").awaitTermination()
    return shown(tables.read_table(t.spark, root, "orders").drop("open", "part"))


@query
def stream_product_upsert(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    tables.append_table(t.products, root, "products")
    pages = documents.parse_pages(live.product_pages(), "products")
    jobs.product_sync_stream(pages, root, progress).awaitTermination()
    return shown(tables.read_table(t.spark, root, "products").drop("bucket"))


@query
def stream_daily_counts(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    jobs.daily_count_stream(live.events, root, progress).awaitTermination()
    return shown(jobs.read_daily_counts(t.spark, root))


@query
def stream_daily_visitors(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    jobs.daily_visitor_stream(live.events, root, progress).awaitTermination()
    return shown(jobs.read_daily_visitors(t.spark, root))


@query
def stream_new_visitors(t: Testbed) -> DataFrame:
    live, root, progress = _stream(t)
    jobs.new_visitor_stream(live.events, root, progress).awaitTermination()
    return shown(jobs.read_new_visitors(t.spark, root))


def _late_stream(t: Testbed) -> str:
    """Events in three deliveries, each with rows of all days: most of the second and third come late."""
    live, root, progress = _stream(t)
    landing = shared_dir(t.spark, "landing-events")
    for k in range(3):
        t.events.filter(F.minute("creation_time") % 3 == k).coalesce(1).write.mode("append").parquet(landing)
        stream = t.spark.readStream.schema(ddl("events")).parquet(landing)
        jobs.late_row_stream(stream, root, progress).awaitTermination()
    return root


@query
def late_rows(t: Testbed) -> DataFrame:
    return shown(jobs.read_late_rows(t.spark, _late_stream(t)))


@query
def restated_days(t: Testbed) -> DataFrame:
    return shown(jobs.read_restated_counts(t.spark, _late_stream(t)))


@query
def stream_daily_visitors_late(t: Testbed) -> DataFrame:
    """Distinct visitors per day when every day's rows come in three deliveries."""
    live, root, progress = _stream(t)
    landing = shared_dir(t.spark, "landing-events")
    for k in range(3):
        t.events.filter(F.minute("creation_time") % 3 == k).coalesce(1).write.mode("append").parquet(landing)
        stream = t.spark.readStream.schema(ddl("events")).parquet(landing)
        jobs.daily_visitor_stream(stream, root, progress).awaitTermination()
    return shown(jobs.read_daily_visitors(t.spark, root))
