"""Shop tables derived from the driver's tables; the rules are listed in FIXTURES.md."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.schemas import conform
from shoplens.session import configure

# Schemas of the driver tables in use. Stating them saves a footer-reading job per read and
# makes the stored times UTC instants, so that filters on them reach the scan.
DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}

EPOCH_2024 = 1704067200
MONTH_SECONDS = 2592000


def client_of(key: str) -> Column:
    return F.concat(F.lit("c"), (F.col(key) % 3).cast("string"))


def order_seconds(key: str) -> Column:
    return F.lit(EPOCH_2024).cast("bigint") + (F.col(key) * 7919) % MONTH_SECONDS


def order_time(key: str) -> Column:
    return F.timestamp_seconds(order_seconds(key))


def at_utc(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


class Testbed:
    """Lazy shop tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clicks(self) -> DataFrame:
        """The event stream with its tenant and session."""
        return self.raw("events").select(
            "*",
            client_of("user_id").alias("client_id"),
            F.concat(
                F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), F.dayofmonth("ts").cast("string")
            ).alias("session_id"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        kind = F.col("event_type")
        page = F.concat(F.lit("/products/part-"), (F.col("event_id") % 50).cast("string"))
        name = (
            F.when(kind == "view", "home")
            .when(kind == "click", "collection")
            .when(kind == "signup", "product")
            .when(kind == "error", "cart")
        )
        url = (
            F.when(kind == "view", "/")
            .when(kind == "click", "/collections/all")
            .when(kind == "signup", page)
            .when(kind == "error", "/cart")
        )
        return self.clicks.filter(kind != "purchase").select(
            "client_id", "session_id", name.alias("event_name"), F.col("ts").alias("creation_time"), url.alias("url")
        )

    @cached_property
    def events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.clicks.filter(kind.isin("view", "click")).select(
            F.concat(F.lit("v"), ((F.col("user_id") % 10) % 3).cast("string")).alias("variation_id"),
            "client_id",
            F.lit("e1").alias("experiment_id"),
            "session_id",
            F.when(kind == "view", "served").otherwise("clicked").alias("event_name"),
            F.col("ts").alias("creation_time"),
        )

    @cached_property
    def visitors(self) -> DataFrame:
        region = self.raw("region").select(F.col("r_regionkey").alias("_r"), F.col("r_name").alias("region"))
        user = F.col("user_id")
        rows = self.clicks.filter(F.col("event_type").isin("view", "signup")).join(
            region, user % 7 == F.col("_r"), "left"
        )
        return conform(
            rows.select(
                "client_id",
                "session_id",
                "region",
                F.concat(F.lit("d"), (user % 3).cast("string")).alias("device"),
                F.concat(F.lit("b"), (user % 4).cast("string")).alias("browser"),
                F.concat(F.lit("o"), (user % 5).cast("string")).alias("os"),
                F.col("ts").alias("creation_time"),
            ),
            "visitors",
        )

    @cached_property
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        text = key.cast("string")
        landing = (
            F.when(key % 5 == 0, "/")
            .when(key % 5 == 1, "/collections/all")
            .when(key % 5 == 2, F.concat(F.lit("/products/part-"), F.col("l_partkey").cast("string")))
            .when(key % 5 == 3, "/checkouts/x")
        )
        return conform(
            self.raw("orders")
            .join(self.raw("lineitem"), key == F.col("l_orderkey"))
            .select(
                client_of("o_custkey").alias("client_id"),
                key.alias("order_id"),
                F.concat(F.lit("mail-"), F.col("o_custkey").cast("string")).alias("email_id"),
                F.concat(F.lit("cart-"), text).alias("cart_token"),
                F.col("l_partkey").alias("product_id"),
                (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("variant_id"),
                F.col("l_quantity").cast("int").alias("variant_quantity"),
                F.col("l_extendedprice").cast("decimal(8,2)").alias("variant_price"),
                order_time("o_orderkey").alias("updated_at"),
                (F.col("o_orderstatus") != "P").alias("payment_status"),
                landing.alias("landing_page"),
            ),
            "orders",
        )

    @cached_property
    def cookies(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.raw("orders")
            .filter(F.col("o_orderpriority") != "5-LOW")
            .select(
                client_of("o_custkey").alias("client_id"),
                F.concat(
                    F.lit("s"),
                    (F.col("o_custkey") % 150).cast("string"),
                    F.lit("_"),
                    F.dayofmonth(order_time("o_orderkey")).cast("string"),
                ).alias("session_id"),
                F.concat(F.lit("cart-"), key.cast("string")).alias("cart_token"),
                order_time("o_orderkey").alias("creation_time"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        text = key.cast("string")
        return self.raw("part").select(
            client_of("p_partkey").alias("client_id"),
            key.alias("product_id"),
            F.concat(F.col("p_name"), F.lit(" "), text).alias("product_title"),
            F.concat(F.lit("part-"), text).alias("product_handle"),
            (key * 10 + 1).alias("variant_id"),
            F.lit("Default Title").alias("variant_title"),
            F.col("p_retailprice").cast("decimal(8,2)").alias("variant_price"),
            order_time("p_partkey").alias("updated_at"),
            F.when(F.col("p_size") % 5 == 0, "")
            .otherwise(F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand")))
            .alias("tags"),
        )

    @cached_property
    def _tenants(self) -> DataFrame:
        return self.raw("customer").select(
            "*", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id")
        )

    @cached_property
    def clients(self) -> DataFrame:
        key = F.col("c_custkey")
        zone = F.when(key % 3 == 0, "UTC").when(key % 3 == 1, "Asia/Kolkata").otherwise("America/New_York")
        return conform(
            self._tenants.select(
                "client_id",
                F.col("c_name").alias("full_name"),
                F.col("c_mktsegment").alias("company_name"),
                (F.col("c_acctbal") < 0).alias("disabled"),
                F.concat(F.lit("https://shop-"), key.cast("string"), F.lit(".example")).alias("shopify_app_eg_url"),
                zone.alias("client_timezone"),
                F.timestamp_seconds(F.lit(EPOCH_2024 - MONTH_SECONDS).cast("bigint") + key % 86400).alias("creation_time"),
            ),
            "clients",
        )

    @cached_property
    def experiments(self) -> DataFrame:
        """Two experiments per tenant: e1 is the latest one."""

        def row(name: str, title: str, created: str, updated: str) -> Column:
            return F.struct(
                F.lit(name).alias("experiment_id"),
                F.lit(title).alias("experiment_name"),
                at_utc(created).alias("creation_time"),
                at_utc(updated).alias("last_updation_time"),
            )

        both = F.array(
            row("e1", "Hero banner", "2024-01-02 00:00:00", "2024-01-20 00:00:00"),
            row("e0", "Button colour", "2023-12-01 00:00:00", "2024-01-10 00:00:00"),
        )
        rows = self._tenants.select("client_id", F.col("c_mktsegment").alias("page_type"), F.inline(both))
        return conform(
            rows.withColumn("experiment_type", F.lit("split")).withColumn("status", F.lit("active")), "experiments"
        )

    @cached_property
    def variations(self) -> DataFrame:
        """Three arms of e1 (a fourth, never served, for odd tenants) and a single arm of e0."""

        def row(experiment: str, arm: str, title: str, share: int) -> Column:
            return F.struct(
                F.lit(experiment).alias("experiment_id"),
                F.lit(arm).alias("variation_id"),
                F.lit(title).alias("variation_name"),
                F.lit(share).alias("traffic_percentage"),
            )

        arms = [
            row("e1", "v0", "Control", 34),
            row("e1", "v1", "Variant A", 33),
            row("e1", "v2", "Variant B", 33),
            row("e0", "w0", "Only", 100),
        ]
        unserved = row("e1", "v3", "Never served", 0)
        listed = F.when(F.col("c_custkey") % 2 == 1, F.array(*arms, unserved)).otherwise(F.array(*arms))
        return conform(self._tenants.select("client_id", F.inline(listed)), "variations")

    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(
            F.lit("Feature").alias("type"),
            F.col("r_regionkey").cast("string").alias("id"),
            F.col("r_name").alias("region_name"),
            F.lit(None).cast("string").alias("geometry"),
        )

    def order_documents(self, entries: str) -> DataFrame:
        """One feed page per row of ``orders`` with 0 to 3 line items, as (client_id, page).

        Orders of the two lowest priorities have no cart: a null token or an empty one.
        """
        key = F.col("o_orderkey")
        priority = F.col("o_orderpriority")
        token = (
            F.when(priority == "5-LOW", F.lit(None).cast("string"))
            .when(priority == "4-NOT SPECIFIED", "")
            .otherwise(F.concat(F.lit("cart-"), key.cast("string")))
        )

        def item(_: Column, position: Column) -> Column:
            i = position.cast("bigint") + 1
            product = key % 997 + i
            return F.struct(
                (product * 10 + i).alias("variant_id"),
                i.cast("string").alias("quantity"),
                product.alias("product_id"),
                (F.col("o_custkey") % 500 + i).cast("decimal(8,2)").cast("string").alias("price"),
            )

        items = F.transform(F.array_repeat(F.lit(0), (key % 4).cast("int")), item)
        order = F.struct(
            key.alias("id"),
            F.concat(F.lit("mail-"), F.col("o_custkey").cast("string")).alias("email"),
            token.alias("cart_token"),
            F.date_format(order_time("o_orderkey"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("updated_at"),
            F.lit("/").alias("landing_site"),
            items.alias("line_items"),
        )
        return self.raw("orders").select(
            "o_orderkey", "o_orderstatus", client_of("o_custkey").alias("client_id"), F.array(order).alias(entries)
        )

    def order_pages(self) -> DataFrame:
        """Order feed pages as JSON text: the paid orders."""
        docs = self.order_documents("orders").filter(F.col("o_orderstatus") != "P")
        return docs.select("client_id", F.to_json(F.struct("orders")).alias("body"))

    def checkout_pages(self) -> DataFrame:
        """Checkout feed pages as JSON text: the open orders."""
        docs = self.order_documents("checkouts").filter(F.col("o_orderstatus") == "P")
        return docs.select("client_id", F.to_json(F.struct("checkouts")).alias("body"))

    def product_pages(self) -> DataFrame:
        """Product feed pages as JSON text with two variants per part."""
        key = F.col("p_partkey")
        text = key.cast("string")

        def variant(i: int) -> Column:
            return F.struct(
                (key * 10 + i).alias("id"),
                F.lit(f"Size {i}").alias("title"),
                (F.col("p_retailprice").cast("decimal(8,2)") + i).cast("decimal(8,2)").cast("string").alias("price"),
                F.date_format(order_time("p_partkey"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("updated_at"),
            )

        product = F.struct(
            key.alias("id"),
            F.concat(F.col("p_name"), F.lit(" "), text).alias("title"),
            F.concat(F.lit("part-"), text).alias("handle"),
            F.date_format(order_time("p_partkey"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("updated_at"),
            F.col("p_type").alias("tags"),
            F.array(variant(1), variant(2)).alias("variants"),
        )
        return self.raw("part").select(
            client_of("p_partkey").alias("client_id"), F.to_json(F.struct(F.array(product).alias("products"))).alias("body")
        )

    def cookie_registrations(self) -> DataFrame:
        """Raw cookie calls, one per order line, many repeated and some empty."""
        token = F.when(F.col("l_returnflag") == "R", "").otherwise(
            F.concat(F.lit("cart-"), F.col("l_orderkey").cast("string"))
        )
        return self.raw("lineitem").select(
            client_of("l_orderkey").alias("client_id"),
            F.concat(F.lit("s"), (F.col("l_suppkey") % 150).cast("string")).alias("session_id"),
            token.alias("cart_token"),
            (order_seconds("l_orderkey") + F.col("l_linenumber")).alias("creation_time"),
        )
