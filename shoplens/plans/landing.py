"""Landing pages: sessions that opened on each page class against paid order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ratio import percent
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators.sales import landing_orders
from shoplens.operators.traffic import landing_sessions, visits_in
from shoplens.plans.funnel import first_extreme

# Fixed page classes and their names in the report.
LANDING_PAGES = [("home", "Home Page"), ("collection", "Collections Page"), ("product", "Product Page")]
_TYPES = [name for name, _ in LANDING_PAGES]


def _per_type(df: DataFrame, column: str, value: str, prefix: str) -> DataFrame:
    return df.groupBy("client_id").agg(
        *[F.max(F.when(F.col(column) == t, F.col(value))).alias(f"{prefix}_{t}") for t in _TYPES]
    )


def _wide(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """One row per tenant with an array of the three page classes."""
    seen = landing_sessions(visits_in(visits, clients, window))
    bought = landing_orders(window.restrict(orders, "updated_at", clients))
    zero = F.lit(0).cast("bigint")

    def page(i: int):
        kind, name = LANDING_PAGES[i]
        visitors = F.coalesce(f"v_{kind}", zero)
        conversions = F.coalesce(f"c_{kind}", zero)
        return F.struct(
            F.lit(i + 1).alias("page_id"),
            F.lit(name).alias("page"),
            F.greatest(visitors - conversions, zero).alias("non_conversion_count"),
            conversions.alias("conversion_count"),
            percent(conversions, F.greatest(visitors, conversions)).alias("conversion_percentage"),
        )

    return (
        clients.select("client_id")
        .join(_per_type(seen, "event_name", "visitor_count", "v").withColumn("_seen", F.lit(True)), "client_id", "left")
        .join(_per_type(bought, "page_type", "conversion_count", "c").withColumn("_sold", F.lit(True)), "client_id", "left")
        .select(
            "client_id",
            F.coalesce("_seen", "_sold", F.lit(False)).alias("enough"),
            F.array(*[page(i) for i in range(len(LANDING_PAGES))]).alias("pages"),
        )
    )


def landing_page_conversion(
    visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow
) -> DataFrame:
    """client_id, page_id, page, non_conversion_count, conversion_count, conversion_percentage."""
    return _wide(visits, orders, clients, window).select("client_id", F.inline("pages"))


def landing_worst(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """Per tenant the page class that converts least, if there is any data."""
    rates = [F.col("pages")[i]["conversion_percentage"] for i in range(len(LANDING_PAGES))]
    worst = F.element_at("pages", first_extreme(rates, largest=False))
    return _wide(visits, orders, clients, window).select(
        "client_id",
        F.when(F.col("enough"), "enough").otherwise("not_enough").alias("status"),
        F.when(F.col("enough"), worst["page"]).alias("page"),
        F.when(F.col("enough"), worst["conversion_percentage"]).alias("conversion_percentage"),
    )
