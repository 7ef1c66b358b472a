"""Column names and types of the shop tables and of the nested feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES: dict[str, dict[str, str]] = {
    "experiments": {
        "experiment_id": "string",
        "client_id": "string",
        "experiment_name": "string",
        "page_type": "string",
        "experiment_type": "string",
        "status": "string",
        "creation_time": "timestamp",
        "last_updation_time": "timestamp",
        "start_time": "timestamp",
        "end_time": "timestamp",
    },
    "clients": {
        "client_id": "string",
        "full_name": "string",
        "company_name": "string",
        "disabled": "boolean",
        "shopify_app_eg_url": "string",
        "client_timezone": "string",
        "creation_time": "timestamp",
    },
    "variations": {
        "variation_id": "string",
        "variation_name": "string",
        "client_id": "string",
        "experiment_id": "string",
        "traffic_percentage": "int",
    },
    "events": {
        "variation_id": "string",
        "client_id": "string",
        "experiment_id": "string",
        "session_id": "string",
        "event_name": "string",
        "creation_time": "timestamp",
    },
    "visits": {
        "client_id": "string",
        "session_id": "string",
        "event_name": "string",
        "creation_time": "timestamp",
        "url": "string",
    },
    "products": {
        "client_id": "string",
        "product_id": "bigint",
        "product_title": "string",
        "product_handle": "string",
        "variant_id": "bigint",
        "variant_title": "string",
        "variant_price": "decimal(8,2)",
        "updated_at": "timestamp",
        "tags": "string",
    },
    "orders": {
        "client_id": "string",
        "order_id": "bigint",
        "email_id": "string",
        "cart_token": "string",
        "product_id": "bigint",
        "variant_id": "bigint",
        "variant_quantity": "int",
        "variant_price": "decimal(8,2)",
        "updated_at": "timestamp",
        "payment_status": "boolean",
        "landing_page": "string",
    },
    "cookies": {
        "client_id": "string",
        "session_id": "string",
        "cart_token": "string",
        "creation_time": "timestamp",
    },
    "visitors": {
        "client_id": "string",
        "session_id": "string",
        "ip": "string",
        "city": "string",
        "region": "string",
        "country": "string",
        "lat": "string",
        "long": "string",
        "timezone": "string",
        "browser": "string",
        "os": "string",
        "device": "string",
        "fingerprint": "string",
        "creation_time": "timestamp",
    },
    "regions": {
        "type": "string",
        "id": "string",
        "region_name": "string",
        "geometry": "string",
    },
}

# The column that holds the row's time, for the append-only tables laid out by day.
EVENT_TIME = {
    "events": "creation_time",
    "visits": "creation_time",
    "cookies": "creation_time",
    "visitors": "creation_time",
}

# Prices and quantities arrive as text or numbers; they are read as text and cast with checks.
LINE_ITEMS = "array<struct<variant_id: bigint, quantity: string, product_id: bigint, price: string>>"
ORDER = (
    "struct<id: bigint, email: string, cart_token: string, updated_at: string,"
    f" landing_site: string, line_items: {LINE_ITEMS}>"
)
VARIANTS = "array<struct<id: bigint, title: string, price: string, updated_at: string>>"
PRODUCT = (
    "struct<id: bigint, title: string, handle: string, updated_at: string, tags: string,"
    f" variants: {VARIANTS}>"
)

# One page of each feed; the landing folder adds the tenant as a partition column.
FEED_PAGES: dict[str, str] = {
    "orders": f"orders array<{ORDER}>",
    "checkouts": f"checkouts array<{ORDER}>",
    "products": f"products array<{PRODUCT}>",
}


def ddl(table: str) -> str:
    """The table's schema as a DDL string for readers."""
    return ", ".join(f"`{name}` {kind}" for name, kind in TABLES[table].items())


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns, in order and type; a missing column becomes null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in TABLES[table].items()
        ]
    )
