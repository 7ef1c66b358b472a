"""Nested order, checkout and product feeds as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.text import filled
from shoplens.functions.timeutil import iso_to_time
from shoplens.schemas import TABLES, conform

# Columns that may not be missing in an accepted row.
ORDER_REQUIRED = (
    "client_id",
    "order_id",
    "product_id",
    "variant_id",
    "updated_at",
    "variant_quantity",
    "variant_price",
)
PRODUCT_REQUIRED = (
    "client_id",
    "product_id",
    "variant_id",
    "product_title",
    "product_handle",
    "variant_price",
    "updated_at",
)


def entries_of(pages: DataFrame, entries: str, name: str) -> DataFrame:
    """One row per document of the pages.

    The outer form keeps Spark from testing the array's size below the explode, which would
    parse each page's text again for the test.
    """
    return pages.select("client_id", F.explode_outer(entries).alias(name)).filter(F.col(name).isNotNull())


def _line(order: Column, item: Column) -> dict[str, Column]:
    """The columns that an order line takes from its document and its item."""
    return {
        "order_id": order["id"],
        "email_id": order["email"],
        "cart_token": order["cart_token"],
        "updated_at": iso_to_time(order["updated_at"]),
        "landing_page": order["landing_site"],
        "product_id": item["product_id"],
        "variant_id": item["variant_id"],
        "variant_quantity": item["quantity"].try_cast("int"),
        "variant_price": item["price"].try_cast("decimal(8,2)"),
    }


def _order_lines(pages: DataFrame, entries: str, is_paid: bool) -> DataFrame:
    lines = entries_of(pages, entries, "o").select("client_id", "o", F.explode("o.line_items").alias("i"))
    columns = _line(F.col("o"), F.col("i"))
    return lines.select(
        "client_id", *[c.alias(name) for name, c in columns.items()], F.lit(is_paid).alias("payment_status")
    )


def anonymous_token(kind: str) -> Column:
    """Stable stand-in for a missing identity of an order; a re-run yields the same one."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "client_id", F.col("order_id").cast("string")), 256), 1, 32)


def _own_cart(given: Column) -> Column:
    return F.when(filled(given), given).otherwise(anonymous_token("cart"))


def order_rows(pages: DataFrame) -> DataFrame:
    """Paid order lines; an order without a cart gets a cart of its own."""
    lines = _order_lines(pages, "orders", True)
    return conform(lines.withColumn("cart_token", _own_cart(F.col("cart_token"))), "orders")


def checkout_rows(pages: DataFrame) -> DataFrame:
    """Lines of open checkouts, unpaid."""
    return conform(_order_lines(pages, "checkouts", False), "orders")


def order_batch(order_pages: DataFrame, checkout_pages: DataFrame) -> DataFrame:
    """Orders and checkouts appended, as one sync run delivers them."""
    return order_rows(order_pages).unionByName(checkout_rows(checkout_pages))


def order_documents(order_pages: DataFrame, checkout_pages: DataFrame) -> DataFrame:
    """One row per order or checkout: client_id, order_id, ``version`` and its complete lines as ``rows``.

    Of several versions of one document the one updated last counts, and of these a paid one. Documents
    without an id or a readable time are left out: they change nothing, and their lines are rejected.
    """
    entries = [
        entries_of(pages, name, "o").select(
            "client_id", "o", F.lit(is_paid).alias("paid"), iso_to_time(F.col("o.updated_at")).alias("version")
        )
        for pages, name, is_paid in ((order_pages, "orders", True), (checkout_pages, "checkouts", False))
    ]
    known = entries[0].unionByName(entries[1]).filter(F.col("o.id").isNotNull() & F.col("version").isNotNull())
    last = known.groupBy("client_id", F.col("o.id").alias("order_id")).agg(
        F.max_by(F.struct("o", "paid"), F.struct("version", "paid")).alias("d"), F.max("version").alias("version")
    )

    def line(item: Column) -> Column:
        columns = {"client_id": F.col("client_id"), **_line(F.col("d.o"), item), "payment_status": F.col("d.paid")}
        columns["cart_token"] = F.when(F.col("d.paid"), _own_cart(columns["cart_token"])).otherwise(columns["cart_token"])
        return F.struct(*[columns[name].cast(kind).alias(name) for name, kind in TABLES["orders"].items()])

    lines = F.transform(F.coalesce("d.o.line_items", F.array()), line)
    whole = F.filter(lines, lambda r: F.forall(F.array(*[r[c].isNotNull() for c in ORDER_REQUIRED]), lambda there: there))
    return last.select("client_id", "order_id", "version", whole.alias("rows"))


def named_documents(order_pages: DataFrame, checkout_pages: DataFrame) -> DataFrame:
    """Ids (client_id, order_id) and last ``version`` of all documents, with or without lines; a null id for an empty page."""
    ids = [
        pages.filter(F.col(entries).isNotNull())
        .select("client_id", F.explode_outer(entries).alias("d"))
        .select("client_id", F.col("d.id").cast("bigint").alias("order_id"), iso_to_time(F.col("d.updated_at")).alias("version"))
        for pages, entries in ((order_pages, "orders"), (checkout_pages, "checkouts"))
    ]
    return ids[0].unionByName(ids[1]).groupBy("client_id", "order_id").agg(F.max("version").alias("version"))


def product_rows(pages: DataFrame) -> DataFrame:
    """One row per product variant, with the variant's own update time."""
    variants = entries_of(pages, "products", "p").select(
        "client_id", "p", F.explode("p.variants").alias("v")
    )
    return conform(
        variants.select(
            "client_id",
            F.col("p.id").alias("product_id"),
            F.col("p.title").alias("product_title"),
            F.col("p.handle").alias("product_handle"),
            F.col("v.id").alias("variant_id"),
            F.col("v.title").alias("variant_title"),
            F.col("v.price").try_cast("decimal(8,2)").alias("variant_price"),
            iso_to_time(F.col("v.updated_at")).alias("updated_at"),
            F.col("p.tags").alias("tags"),
        ),
        "products",
    )


def complete(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows that hold every required column; a bad row no longer spoils its batch."""
    return rows.dropna(subset=list(required))


def rejected(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """The other rows, with the names of what they miss."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return rows.withColumn("missing", missing).filter(F.size("missing") > 0)


def anonymous_carts(pages: DataFrame) -> DataFrame:
    """Cookie rows that tie the orders without a cart to a session of their own."""
    orders = entries_of(pages, "orders", "o").select(
        "client_id",
        F.col("o.id").alias("order_id"),
        F.col("o.cart_token").alias("given"),
        iso_to_time(F.col("o.updated_at")).alias("creation_time"),
    )
    return (
        orders.filter(~filled(F.col("given")) & F.col("order_id").isNotNull())
        .groupBy("client_id", "order_id")
        .agg(F.max("creation_time").alias("creation_time"))
        .select(
            "client_id",
            anonymous_token("session").alias("session_id"),
            anonymous_token("cart").alias("cart_token"),
            "creation_time",
        )
    )


def order_watermark(orders: DataFrame) -> DataFrame:
    """Per tenant the time from which paid orders are still missing: the last one plus 1 s."""
    return (
        orders.filter("payment_status")
        .groupBy("client_id")
        .agg((F.max("updated_at") + F.expr("interval 1 second")).alias("watermark"))
    )


def product_watermark(products: DataFrame) -> DataFrame:
    return products.groupBy("client_id").agg(F.max("updated_at").alias("watermark"))


def since(rows: DataFrame, watermark: DataFrame) -> DataFrame:
    """Rows at or after their tenant's watermark; everything for a tenant without one."""
    return (
        rows.join(watermark, "client_id", "left")
        .filter(F.col("watermark").isNull() | (F.col("updated_at") >= F.col("watermark")))
        .drop("watermark")
    )
