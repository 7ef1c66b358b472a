"""Shop funnel: six steps, their share of the largest step and the biggest drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ratio import percent
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators.lookups import tagged_union
from shoplens.operators.sales import checkout_counts
from shoplens.operators.traffic import sessions_per_page, visits_in

# Fixed steps of the funnel: page view name or order count, and the page shown.
VISIT_STEPS = [("home", "Home Page"), ("collection", "Collection Page"), ("product", "Product Page"), ("cart", "Cart Page")]
ORDER_STEPS = [("checkouts", "Checkout Page"), ("purchases", "Purchase")]
PAGES = [page for _, page in VISIT_STEPS + ORDER_STEPS]


def _wide(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """One row per tenant with its six counts and percentages.

    Each table is scanned once: page views are counted per page name and turned into columns,
    orders give both of their steps from one grouping.
    """
    names = [name for name, _ in VISIT_STEPS]
    seen = visits_in(visits.filter(F.col("event_name").isin(*names)), clients, window)
    pages = (
        sessions_per_page(seen)
        .groupBy("client_id")
        .agg(*[F.max(F.when(F.col("event_name") == n, F.col("sessions"))).alias(n) for n in names])
    )
    bought = checkout_counts(window.restrict(orders, "updated_at", clients))
    counts = [F.coalesce(n, F.lit(0).cast("bigint")) for n in [*names, *[n for n, _ in ORDER_STEPS]]]
    return (
        clients.select("client_id")
        .join(pages, "client_id", "left")
        .join(bought, "client_id", "left")
        .select("client_id", F.array(*counts).alias("n"))
        .withColumn("top", F.array_max("n"))
        .select(
            "client_id",
            "n",
            F.transform("n", lambda c: percent(c, F.col("top"))).alias("pct"),
        )
    )


def shop_funnel(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """client_id, step_id, page, visitor_count, percentage."""
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_id"),
                F.lit(page).alias("page"),
                F.col("n")[i].alias("visitor_count"),
                F.col("pct")[i].alias("percentage"),
            )
            for i, page in enumerate(PAGES)
        ]
    )
    return _wide(visits, orders, clients, window).select("client_id", F.inline(steps))


def first_extreme(values: list[Column], largest: bool) -> Column:
    """1-based position of the first largest (or smallest) value."""
    best = F.greatest(*values) if largest else F.least(*values)
    return reduce(
        lambda rest, i: F.when(values[i] == best, i + 1).otherwise(rest),
        range(len(values) - 2, -1, -1),
        F.lit(len(values)),
    )


def funnel_churn(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """Per tenant the step that loses most on the way to the next one.

    Without any page view the report says there is not enough data.
    """
    drops = [F.col("pct")[i] - F.col("pct")[i + 1] for i in range(len(PAGES) - 1)]
    enough = F.col("n")[0] + F.col("n")[1] + F.col("n")[2] + F.col("n")[3] > 0
    position = first_extreme(drops, largest=True)
    return _wide(visits, orders, clients, window).select(
        "client_id",
        F.when(enough, "enough").otherwise("not_enough").alias("status"),
        F.when(enough, F.element_at(F.array(*[F.lit(p) for p in PAGES]), position)).alias("page"),
        F.when(enough, F.round(F.greatest(*drops), 2)).alias("drop"),
    )


def shop_funnel_union(visits: DataFrame, orders: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    """The same counts as a UNION of one tagged branch per step, for tenants that have rows.

    Kept to show the set operator; ``shop_funnel`` computes the counts in one pass per table.
    """
    seen = visits_in(visits, clients, window)
    bought = window.restrict(orders, "updated_at", clients)
    branches = [
        seen.filter(F.col("event_name") == name)
        .groupBy("client_id")
        .agg(F.count_distinct("session_id").alias("visitor_count"))
        .select("client_id", F.lit(i + 1).alias("step_id"), F.lit(page).alias("page"), "visitor_count")
        for i, (name, page) in enumerate(VISIT_STEPS)
    ]
    for i, (_, page) in enumerate(ORDER_STEPS):
        rows = bought if i == 0 else bought.filter("payment_status")
        branches.append(
            rows.groupBy("client_id")
            .agg(F.count_distinct("order_id").alias("visitor_count"))
            .select("client_id", F.lit(len(VISIT_STEPS) + i + 1).alias("step_id"), F.lit(page).alias("page"), "visitor_count")
        )
    return tagged_union(*branches)
