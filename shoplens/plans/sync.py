"""The sync jobs: one run for all tenants from landed feed pages to the stored tables.

Every step can run again after a failure and ends in the same tables: merges replace, and the
rows added for anonymous orders are inserted only where absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators import feeds
from shoplens.operators.merge import new_cookies, new_events, serve_latest
from shoplens.sources import versions
from shoplens.sources.documents import unreadable_pages
from shoplens.sources.tables import append_load, append_table, keep_load, read_table


def keep_rejected(rows: DataFrame, required: tuple[str, ...], root: str, table: str, load: str | None = None) -> None:
    """Incomplete feed rows with the names of what they miss, in ``rejected_<table>``."""
    keep_load(feeds.rejected(rows, required), f"{root}/rejected_{table}", load)


def keep_unreadable(pages: DataFrame, root: str, feed: str, load: str | None = None) -> None:
    """The text of pages that could not be read, in ``rejected_pages_<feed>``."""
    keep_load(unreadable_pages(pages), f"{root}/rejected_pages_{feed}", load)


def sync_orders(spark: SparkSession, root: str, order_pages: DataFrame, checkout_pages: DataFrame) -> None:
    """Upsert orders and checkouts; give orders without a cart a session in the latest experiment.

    Rows that miss a required column or have no readable quantity or price go to
    ``rejected_orders``, unreadable pages to ``rejected_pages_*``; they hold up no other row.
    """
    rows = feeds.order_batch(order_pages, checkout_pages)
    keep_rejected(rows, feeds.ORDER_REQUIRED, root, "orders")
    keep_unreadable(order_pages, root, "orders")
    keep_unreadable(checkout_pages, root, "checkouts")
    synced = feeds.named_documents(order_pages, checkout_pages).select("client_id")
    versions.sync_orders(spark, root, feeds.order_documents(order_pages, checkout_pages), synced)
    versions.maintain(spark, root, "orders")
    keep_anonymous(spark, root, order_pages)


def keep_anonymous(spark: SparkSession, root: str, order_pages: DataFrame, load: str | None = None) -> None:
    """Cookies for orders without a cart, and a served event of the latest experiment for their sessions.

    Both are added only where absent. With a load name the rows of that load do not count as stored and are
    replaced, so a micro-batch that runs again writes the same.
    """

    def stored(table: str) -> DataFrame:
        rows = read_table(spark, root, table)
        return rows if load is None else rows.filter(F.col("load") != load)

    def keep(rows: DataFrame, table: str) -> None:
        append_table(rows, root, table) if load is None else append_load(rows, root, table, load)

    carts = feeds.anonymous_carts(order_pages).filter("creation_time is not null")
    keep(new_cookies(stored("cookies"), carts), "cookies")
    events = stored("events")
    served = serve_latest(
        carts.select("client_id", "session_id", "creation_time"),
        read_table(spark, root, "experiments"),
        events,
        read_table(spark, root, "variations"),
    )
    keep(new_events(events, served), "events")


def sync_products(spark: SparkSession, root: str, product_pages: DataFrame) -> None:
    """Upsert product variants; incomplete ones go to ``rejected_products``."""
    rows = feeds.product_rows(product_pages)
    keep_rejected(rows, feeds.PRODUCT_REQUIRED, root, "products")
    keep_unreadable(product_pages, root, "products")
    versions.sync_products(spark, root, feeds.complete(rows, feeds.PRODUCT_REQUIRED))
    versions.maintain(spark, root, "products")
