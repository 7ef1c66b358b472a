"""Product conversion, overall and per tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.ratio import percent
from shoplens.functions.text import NO_TAG, tag_list
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators.sales import product_orders
from shoplens.operators.traffic import product_views, visits_in


def product_dim(products: DataFrame) -> DataFrame:
    """Products without their variants, each once."""
    return products.select("client_id", "product_title", "product_handle", "product_id", "tags").distinct()


def _measured(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> tuple[DataFrame, DataFrame]:
    """Visitors per product page and paid orders per product in the window."""
    return product_views(visits_in(visits, clients, window)), product_orders(window.restrict(orders, "updated_at", clients))


def _conversion(products: DataFrame, seen: DataFrame, bought: DataFrame, how: str = "left") -> DataFrame:
    """Counts of every product; joined in full, also those of pages and orders without a product (``listed`` is null)."""
    zero = F.lit(0).cast("bigint")
    visitors = F.coalesce("visitor_count", zero)
    conversions = F.coalesce("conversion_count", zero)
    return (
        product_dim(products)
        .withColumn("listed", F.lit(True))
        .join(seen, ["client_id", "product_handle"], how)
        .join(bought, ["client_id", "product_id"], how)
        .select(
            "client_id",
            "product_id",
            "product_title",
            "product_handle",
            "tags",
            F.greatest(visitors - conversions, zero).alias("non_conversion_count"),
            conversions.alias("conversion_count"),
            percent(conversions, F.greatest(visitors, conversions)).alias("conversion_percentage"),
            "listed",
            (F.col("visitor_count").isNotNull() | F.col("conversion_count").isNotNull()).alias("active"),
        )
    )


def product_conversion(
    products: DataFrame, visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow
) -> DataFrame:
    """Visitors and distinct paid orders of every product, zero where it has none."""
    return _conversion(products, *_measured(visits, orders, clients, window)).drop("listed", "active")


def product_conversion_by_tag(
    products: DataFrame, visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow
) -> DataFrame:
    """Product conversion repeated under each of the product's tags."""
    return (
        product_conversion(products, visits, orders, clients, window)
        .withColumn("tag", F.explode(tag_list(F.col("tags"))))
        .drop("tags")
    )


def product_worst_by_tag(
    products: DataFrame, visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow
) -> DataFrame:
    """Per tag the product that converts least; the first handle wins a tie.

    A tenant without any product view or paid order in the window has not enough data; that is
    read off the same counts, so each fact table is scanned once.
    """
    worst = F.min(
        F.struct("conversion_percentage", "product_handle", "product_id", "product_title")
    ).alias("w")
    none = F.array(F.lit(None).cast("string"))
    tags = F.when(F.col("listed"), tag_list(F.col("tags"))).otherwise(none)
    per_tag = (
        _conversion(products, *_measured(visits, orders, clients, window), "full")
        .withColumn("tag", F.explode(tags))
        .groupBy("client_id", "listed", "tag")
        .agg(worst, F.bool_or("active").alias("_active"))
    )
    # One row per tag is left of each tenant.
    active = F.bool_or("_active").over(Window.partitionBy("client_id"))
    return (
        per_tag.withColumn("_active", active)
        .filter("listed")
        .select(
            "client_id",
            "tag",
            F.when(F.col("_active"), "enough").otherwise("not_enough").alias("status"),
            F.when(F.col("_active"), F.col("w.product_title")).alias("product_title"),
            F.when(F.col("_active"), F.col("w.conversion_percentage")).alias("conversion_percentage"),
        )
    )


def product_tags(products: DataFrame) -> DataFrame:
    """Tags of each tenant in report order: sorted, the no-tag marker last.

    ``tag_rank`` orders the tags; it is a sort key, not a running number, so no tenant's tags
    are gathered into one task.
    """
    return (
        products.select("client_id", "tags")
        .distinct()
        .select("client_id", F.explode(tag_list(F.col("tags"))).alias("tag"))
        .distinct()
        .withColumn("tag_rank", F.concat(F.when(F.col("tag") == NO_TAG, "1").otherwise("0"), F.col("tag")))
    )
