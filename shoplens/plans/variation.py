"""Reports per variation of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ratio import mean_damped, percent, percent_damped
from shoplens.functions.timeutil import RecentDays, short_day
from shoplens.operators.experiments import ARM, event_counts, variation_event_counts
from shoplens.operators.lookups import experiment_start, variation_list
from shoplens.operators.sales import attributed_sales, sales_by_day


def _or_zero(name: str, kind: str = "bigint") -> Column:
    return F.coalesce(name, F.lit(0).cast(kind)).alias(name)


def goal_table(variations: DataFrame, events: DataFrame) -> DataFrame:
    """Served sessions, visitors and goal conversions of every variation, zero where none."""
    return (
        variation_list(variations)
        .join(variation_event_counts(events), ARM, "left")
        .select(*ARM, "variation_name", *[_or_zero(c) for c in ["num_session", "num_visitor", "goal_conversion_count"]])
    )


def conversion_table(
    variations: DataFrame, experiments: DataFrame, events: DataFrame, orders: DataFrame, cookies: DataFrame
) -> DataFrame:
    """Sessions, visitors, goal and sales conversion and revenue of every variation.

    A variation of an unknown experiment keeps its event counts and has no sales.
    """
    goals = goal_table(variations, events)
    sold = attributed_sales(orders, cookies, events, experiment_start(experiments))
    base = goals.join(sold, ARM, "left").select(
        *goals.columns,
        _or_zero("sales_conversion_count"),
        _or_zero("order_count"),
        _or_zero("total_order_value", "decimal(38,2)"),
    )
    return base.select(
        "*",
        percent_damped(F.col("goal_conversion_count"), F.col("num_visitor")).alias("goal_conversion"),
        percent_damped(F.col("sales_conversion_count"), F.col("num_visitor")).alias("sales_conversion"),
        mean_damped(F.col("total_order_value"), F.col("order_count")).alias("avg_total_order_value"),
    ).withColumn("total_order_value", F.col("total_order_value").cast("double"))


def events_by_day(events: DataFrame, clients: DataFrame, days: RecentDays) -> DataFrame:
    """Served sessions, visitors and goal conversions per variation and local day."""
    return event_counts(days.bucket(events, "creation_time", clients), "day").drop("served_rows")


def daily_sales(
    orders: DataFrame, cookies: DataFrame, events: DataFrame, clients: DataFrame, days: RecentDays
) -> DataFrame:
    """Converted sessions per variation and local day."""
    return sales_by_day(
        days.bucket(orders, "updated_at", clients),
        days.bucket(cookies, "creation_time", clients),
        days.bucket(events, "creation_time", clients),
    )


def day_variation_grid(variations: DataFrame, clients: DataFrame, days: RecentDays) -> DataFrame:
    """Every variation on every one of the last days: an expansion of its row, not a join of days."""
    tz = F.col("_tz")
    first = F.date_sub(days.today(tz), days.days - 1)
    return (
        variation_list(variations)
        .join(clients.select("client_id", days.zone().alias("_tz")), "client_id")
        .withColumn("day", F.explode(F.sequence(first, days.today(tz), F.expr("interval 1 day"))))
        .drop("_tz")
    )


def conversion_over_time(
    variations: DataFrame,
    clients: DataFrame,
    events: DataFrame,
    orders: DataFrame,
    cookies: DataFrame,
    days: RecentDays,
) -> DataFrame:
    """Daily counts and percentages of every variation over the last days."""
    on = [*ARM, "day"]
    served, goals, sales = F.col("num_visitor"), F.col("goal_conversion_count"), F.col("sales_conversion_count")
    rows = (
        day_variation_grid(variations, clients, days)
        .join(events_by_day(events, clients, days), on, "left")
        .join(daily_sales(orders, cookies, events, clients, days), on, "left")
        .select(
            *on,
            "variation_name",
            *[_or_zero(c) for c in ["num_session", "num_visitor", "goal_conversion_count", "sales_conversion_count"]],
        )
    )
    # Nobody converts without having visited, whatever the served counts say.
    visitors = F.greatest(served, goals, sales)
    return rows.select(
        *on,
        "variation_name",
        short_day(F.col("day")).alias("date"),
        F.col("num_session").alias("session_count"),
        visitors.alias("visitor_count"),
        "goal_conversion_count",
        percent(goals, visitors).alias("goal_conversion_percentage"),
        "sales_conversion_count",
        percent(sales, visitors).alias("sales_conversion_percentage"),
    )


SERIES = [
    "session_count",
    "visitor_count",
    "goal_conversion_count",
    "goal_conversion_percentage",
    "sales_conversion_count",
    "sales_conversion_percentage",
]


def conversion_series(over_time: DataFrame) -> DataFrame:
    """One row per variation with a list per measure, in day order.

    A list holds one entry per report day, so its length is set by the report, not the data.
    """
    points = F.sort_array(F.collect_list(F.struct("day", "date", *SERIES)))
    return (
        over_time.groupBy(*ARM, "variation_name")
        .agg(points.alias("p"))
        .select(*ARM, "variation_name", F.col("p.date").alias("date"), *[F.col(f"p.{c}").alias(c) for c in SERIES])
    )
