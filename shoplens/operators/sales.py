"""Counts and sums over order lines, and their way back to sessions.

A cart links sessions to orders many-to-many. Every join below is made between sides that are
already grouped by the join key and the columns still needed, so neither a busy cart nor a
busy session multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.text import page_type
from shoplens.functions.timeutil import after
from shoplens.operators.lookups import first_start


def paid(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("payment_status"))


def line_value() -> Column:
    return F.col("variant_quantity") * F.col("variant_price")


def checkout_counts(orders: DataFrame) -> DataFrame:
    """Orders started and orders paid per tenant, each order once."""
    return (
        orders.groupBy("client_id", "order_id")
        .agg(F.max(F.col("payment_status").cast("int")).alias("_paid"))
        .groupBy("client_id")
        .agg(
            F.count("order_id").alias("checkouts"),
            F.sum(F.when(F.col("order_id").isNotNull(), F.coalesce("_paid", F.lit(0)))).alias("purchases"),
        )
    )


def landing_orders(orders: DataFrame) -> DataFrame:
    """Paid order lines per tenant and class of landing page."""
    return (
        paid(orders)
        .groupBy("client_id", page_type(F.col("landing_page")).alias("page_type"))
        .agg(F.count(F.lit(1)).alias("conversion_count"))
    )


def product_orders(orders: DataFrame) -> DataFrame:
    """Distinct paid orders per product."""
    return (
        paid(orders)
        .groupBy("client_id", "product_id")
        .agg(F.count_distinct("order_id").alias("conversion_count"))
    )


def cart_sessions(cookies: DataFrame) -> DataFrame:
    """Known (cart, session) pairs, each once."""
    return (
        cookies.filter(F.col("cart_token").isNotNull() & F.col("session_id").isNotNull())
        .select("client_id", "cart_token", "session_id")
        .distinct()
    )


def session_arms(events: DataFrame) -> DataFrame:
    """Variations each session met, each once; a session with two variations counts for both."""
    return (
        events.filter(F.col("session_id").isNotNull() & F.col("variation_id").isNotNull())
        .select("client_id", "experiment_id", "variation_id", "session_id")
        .distinct()
    )


def attributed_sales(
    orders: DataFrame, cookies: DataFrame, events: DataFrame, starts: DataFrame
) -> DataFrame:
    """Converted sessions, orders and revenue per variation since its experiment began.

    Revenue adds distinct (session, order, cart, variant, quantity, price) rows: repeated
    events or cookies do not count twice, and equal lines of one order merge. It is built as
    sessions of the cart times the value of the cart's distinct lines. Orders before the first
    experiment began count for none and are not read.
    """
    lines = (
        paid(after(orders, "updated_at", first_start(starts)))
        .filter(F.col("cart_token").isNotNull())
        .groupBy("client_id", "cart_token", "order_id", "variant_id", "variant_quantity", "variant_price")
        .agg(F.max("updated_at").alias("last_update"))
    )
    cart_orders = lines.groupBy("client_id", "cart_token", "order_id", "last_update").agg(
        F.sum(line_value()).alias("value")
    )
    # From the same grouped lines, so both uses share one scan and shuffle of the orders.
    cart_last = lines.groupBy("client_id", "cart_token").agg(F.max("last_update").alias("cart_update"))
    buying = (
        cart_sessions(cookies)
        .join(cart_last, ["client_id", "cart_token"])
        .join(session_arms(events), ["client_id", "session_id"])
        .join(starts, ["client_id", "experiment_id"])
        .filter(F.col("cart_update") > F.col("start_time"))
    )
    arm = ["client_id", "experiment_id", "variation_id"]
    sessions = buying.groupBy(*arm).agg(F.count_distinct("session_id").alias("sales_conversion_count"))
    revenue = (
        buying.groupBy(*arm, "cart_token", "start_time")
        .agg(F.count(F.lit(1)).alias("cart_sessions"))
        .join(cart_orders, ["client_id", "cart_token"])
        .filter(F.col("last_update") > F.col("start_time"))
        .groupBy(*arm, "order_id")
        .agg(F.sum(F.col("cart_sessions") * F.col("value")).alias("value"))
        .groupBy(*arm)
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("value").cast("decimal(38,2)").alias("total_order_value"),
        )
    )
    return sessions.join(revenue, arm)


def sales_by_day(orders: DataFrame, cookies: DataFrame, events: DataFrame) -> DataFrame:
    """Converted sessions per variation and day.

    Inputs carry a ``day``. Cookie, paid order and event must fall on the same day. Only the
    sessions are counted, so the orders act as a filter on carts.
    """
    bought = (
        paid(orders)
        .filter(F.col("cart_token").isNotNull())
        .select("client_id", "day", "cart_token")
        .distinct()
    )
    buyers = (
        cookies.filter(F.col("session_id").isNotNull())
        .select("client_id", "day", "cart_token", "session_id")
        .distinct()
        .join(bought, ["client_id", "day", "cart_token"], "left_semi")
        .select("client_id", "day", "session_id")
        .distinct()
    )
    met = (
        events.filter(F.col("session_id").isNotNull() & F.col("variation_id").isNotNull())
        .select("client_id", "experiment_id", "variation_id", "day", "session_id")
        .distinct()
    )
    # Both sides are unique in their session, so counting rows counts distinct sessions.
    return (
        met.join(buyers, ["client_id", "day", "session_id"])
        .groupBy("client_id", "experiment_id", "variation_id", "day")
        .agg(F.count(F.lit(1)).alias("sales_conversion_count"))
    )


def order_totals(orders: DataFrame, cookies: DataFrame, per_cookie: bool = False) -> DataFrame:
    """Value and session of each paid order; an order without a known cart keeps a null session.

    The smallest session of the cart stands for the order. ``per_cookie`` multiplies the value
    by the number of cookie rows of the cart, as a plain join of the two tables would.
    """
    carts = (
        cookies.filter(F.col("cart_token").isNotNull())
        .groupBy("client_id", "cart_token")
        .agg(F.min("session_id").alias("session_id"), F.count(F.lit(1)).alias("cookies"))
        # The key never matches an order without a cart, whose rows are spread by order id.
        .select("client_id", F.col("cart_token").alias("_key"), F.lit(True).alias("_real"), "session_id", "cookies")
    )
    real = F.col("cart_token").isNotNull()
    per_cart = (
        paid(orders)
        .groupBy("client_id", "order_id", "cart_token")
        .agg(F.sum(line_value()).alias("value"))
        .withColumn("_real", real)
        .withColumn("_key", F.coalesce("cart_token", F.col("order_id").cast("string")))
    )
    times = F.greatest(F.coalesce("cookies", F.lit(1)), F.lit(1)) if per_cookie else F.lit(1)
    return (
        per_cart.join(carts, ["client_id", "_key", "_real"], "left")
        .groupBy("client_id", "order_id")
        .agg(
            F.min("session_id").alias("session_id"),
            F.sum(F.col("value") * times).cast("decimal(38,2)").alias("total_order_value"),
        )
    )


def order_sessions(orders: DataFrame, cookies: DataFrame) -> DataFrame:
    """Number of known sessions behind each paid order, 0 when its cart has no cookie."""
    carts = (
        cart_sessions(cookies)
        .groupBy("client_id", "cart_token")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select("client_id", F.col("cart_token").alias("_key"), F.lit(True).alias("_real"), "sessions")
    )
    return (
        paid(orders)
        .groupBy("client_id", "order_id", "cart_token")
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("_real", F.col("cart_token").isNotNull())
        .withColumn("_key", F.coalesce("cart_token", F.col("order_id").cast("string")))
        .join(carts, ["client_id", "_key", "_real"], "left")
        .select("client_id", "order_id", "cart_token", "lines", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    )


def session_orders(totals: DataFrame) -> DataFrame:
    """Orders and revenue per session, from one row per order."""
    return totals.groupBy("client_id", "session_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("total_order_value").cast("decimal(38,2)").alias("revenue"),
    )
