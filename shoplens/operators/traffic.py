"""Counts over page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.text import last_path_segment
from shoplens.functions.timeutil import ReportWindow

# Fixed page views that can open a session, in the order that breaks a tie in time.
ENTRY_PAGES = ("collection", "home", "product")


def visits_in(visits: DataFrame, clients: DataFrame, window: ReportWindow) -> DataFrame:
    return window.restrict(visits, "creation_time", clients)


def sessions_per_page(visits: DataFrame) -> DataFrame:
    """Distinct sessions per tenant and page view name."""
    return visits.groupBy("client_id", "event_name").agg(F.count_distinct("session_id").alias("sessions"))


def first_touch(visits: DataFrame) -> DataFrame:
    """The first page view of each session.

    Time and page rank are packed into one integer, so its minimum is a hash aggregate with a
    partial step: a hot session, or the sessionless rows (one group), shrink before the shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in ENTRY_PAGES]), F.col("event_name")) - 1
    packed = F.unix_micros("creation_time") * len(ENTRY_PAGES) + rank
    width = F.lit(len(ENTRY_PAGES))
    pages = F.array(*[F.lit(p) for p in ENTRY_PAGES])
    first_rank = F.pmod(F.col("_first"), width)
    first_micros = F.call_function("div", F.col("_first") - first_rank, width)
    return (
        visits.filter(F.col("event_name").isin(*ENTRY_PAGES))
        .groupBy("client_id", "session_id")
        .agg(F.min(packed).alias("_first"))
        .select(
            "client_id",
            "session_id",
            F.element_at(pages, (first_rank + 1).cast("int")).alias("event_name"),
            F.timestamp_micros(first_micros).alias("first_time"),
        )
    )


def landing_sessions(visits: DataFrame) -> DataFrame:
    """Sessions per tenant and opening page."""
    return first_touch(visits).groupBy("client_id", "event_name").agg(F.count(F.lit(1)).alias("visitor_count"))


def product_views(visits: DataFrame) -> DataFrame:
    """Visitors per product handle: distinct sessions of each url, summed over its urls; a null handle for none."""
    return (
        visits.filter(F.col("event_name") == "product")
        .groupBy("client_id", "url")
        .agg(F.count_distinct("session_id").alias("sessions"))
        .groupBy("client_id", last_path_segment(F.col("url")).alias("product_handle"))
        .agg(F.sum("sessions").alias("visitor_count"))
    )


def product_visits(visits: DataFrame) -> DataFrame:
    """The counts of ``product_views`` for views with a url."""
    return product_views(visits.filter(F.col("url").isNotNull()))
