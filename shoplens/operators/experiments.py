"""Event counts of experiments and the assignment of sessions to variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.timeutil import elapsed_hours

ARM = ["client_id", "experiment_id", "variation_id"]


def _named(name: str) -> Column:
    return (F.col("event_name") == name).cast("int")


def event_counts(events: DataFrame, *extra: str) -> DataFrame:
    """Served sessions, visitors and goal conversions per variation (and ``extra`` columns).

    One pass: rows are first reduced to one per session, with its served and clicked counts,
    then counted. ``served_rows`` tells whether the variation was served at all, including
    rows without a session.
    """
    key = [*ARM, *extra]
    known = F.col("session_id").isNotNull()
    return (
        events.filter(F.col("event_name").isin("served", "clicked"))
        .groupBy(*key, "session_id")
        .agg(F.sum(_named("served")).alias("_served"), F.sum(_named("clicked")).alias("_clicked"))
        .groupBy(*key)
        .agg(
            F.sum("_served").alias("served_rows"),
            F.sum(F.when(known, F.col("_served")).otherwise(0)).alias("num_session"),
            F.sum((known & (F.col("_served") > 0)).cast("int")).alias("num_visitor"),
            F.sum((known & (F.col("_clicked") > 0)).cast("int")).alias("goal_conversion_count"),
        )
    )


def variation_event_counts(events: DataFrame) -> DataFrame:
    """Counts of the variations that were served; clicks of an unserved one are left out."""
    return event_counts(events).filter(F.col("served_rows") > 0).drop("served_rows")


def experiment_span(experiments: DataFrame, events: DataFrame) -> DataFrame:
    """Start, last event and whole hours between them."""
    last = events.groupBy("client_id", "experiment_id").agg(F.max("creation_time").alias("end_time"))
    return experiments.select(
        "client_id", "experiment_id", F.col("creation_time").alias("start_time")
    ).join(last, ["client_id", "experiment_id"], "left").withColumn(
        "num_hour", elapsed_hours(F.col("start_time"), F.col("end_time"))
    )


def assignment_slot(session_id: Column, experiment_id: Column, arms: Column) -> Column:
    """Stable uniform slot of a session: the same on every run, executor and retry."""
    head = F.substring(F.md5(F.concat(session_id, F.lit("|"), experiment_id)), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % arms


def assign(requests: DataFrame, events: DataFrame, variations: DataFrame) -> DataFrame:
    """Add the variation of each request (client_id, experiment_id, session_id, ...).

    A session that already has an event keeps its earliest variation; any other gets a stable
    slot. Requests of an experiment without variations and history are dropped.
    """
    first = F.struct("creation_time", "variation_id")
    sticky = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("client_id", "experiment_id", "session_id")
        .agg(F.min(first).getField("variation_id").alias("_sticky"))
    )
    arm = F.sort_array(F.collect_list(F.struct("variation_id")))
    arms = variations.groupBy("client_id", "experiment_id").agg(arm.alias("_arms"))
    slot = assignment_slot(F.col("session_id"), F.col("experiment_id"), F.size("_arms"))
    fresh = F.get("_arms", slot.cast("int")).getField("variation_id")
    return (
        requests.join(sticky, ["client_id", "experiment_id", "session_id"], "left")
        .join(arms, ["client_id", "experiment_id"], "left")
        .withColumn("variation_id", F.coalesce(F.col("_sticky"), fresh))
        .filter(F.col("variation_id").isNotNull())
        .drop("_sticky", "_arms")
    )


def served_events(requests: DataFrame, events: DataFrame, variations: DataFrame) -> DataFrame:
    """The 'served' event rows that answering the requests adds."""
    return assign(requests, events, variations).select(
        "variation_id",
        "client_id",
        "experiment_id",
        "session_id",
        F.lit("served").alias("event_name"),
        "creation_time",
    )
