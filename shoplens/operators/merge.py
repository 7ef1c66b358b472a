"""Upserts and first-write-wins inserts as anti joins plus append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.text import filled
from shoplens.operators.experiments import assign, served_events
from shoplens.operators.lookups import latest_experiment


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Target rows whose key is not listed."""
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def upsert_orders(
    target: DataFrame, batch: DataFrame, named: DataFrame | None = None, whole_snapshots: bool = True
) -> DataFrame:
    """Replace the orders that the feed names and the open checkouts of the tenants it names.

    ``named`` (client_id, order_id, version) lists the feed's documents, also those without any line
    left; a null id marks a tenant that was synced without documents. Without it the batch's rows
    count. Checkouts arrive as a full snapshot, so every unpaid row of a synced tenant goes, unless
    ``whole_snapshots`` is off: then only the named ones do. A stored order that was updated after
    the feed's version of it stays, open or paid.
    """
    key = ["client_id", "order_id"]
    named = batch.withColumn("version", F.col("updated_at")) if named is None else named
    versions = named.groupBy(*key).agg(F.max("version").alias("_version"))
    # One row per stored order and per named one, so that each of the wide tables meets one join.
    last = target.groupBy(*key).agg(F.max("updated_at").alias("_last"))
    newer = F.coalesce(F.col("_last") > F.col("_version"), F.lit(False))
    named = versions.join(last, key, "left").select(*key, newer.alias("_newer"))
    marked = target.join(named, key, "left")
    # Null where the feed does not name the order.
    stays = F.coalesce("_newer", F.lit(True))
    if whole_snapshots:
        tenants = versions.select("client_id").distinct().withColumn("_synced", F.lit(True))
        marked = marked.join(tenants, "client_id", "left")
        stays &= F.coalesce("payment_status", F.lit(True)) | F.coalesce("_newer", F.col("_synced").isNull())
    kept = marked.filter(stays).select(*key, *[c for c in target.columns if c not in key])
    return kept.unionByName(delete_keys(batch, named.filter("_newer"), key))


def upsert_products(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace the variants the batch names."""
    return delete_keys(target, batch, ["client_id", "variant_id"]).unionByName(batch)


def new_cookies(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming cookies not stored yet, the earliest of each (session, cart), none empty."""
    key = ["client_id", "session_id", "cart_token"]
    return (
        incoming.filter(filled(F.col("session_id")) & filled(F.col("cart_token")))
        .groupBy(*key)
        .agg(F.min("creation_time").alias("creation_time"))
        .join(stored.select(*key).distinct(), key, "left_anti")
    )


def new_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events of sessions that have no event at all in that experiment.

    Of several incoming rows of one session the earliest is kept.
    """
    key = ["client_id", "experiment_id", "session_id"]
    first = F.min(F.struct("creation_time", "variation_id", "event_name")).alias("e")
    return (
        incoming.join(stored.select(*key).distinct(), key, "left_anti")
        .groupBy(*key)
        .agg(first)
        .select("e.variation_id", *key, "e.event_name", "e.creation_time")
    )


def serve_latest(
    sessions: DataFrame, experiments: DataFrame, events: DataFrame, variations: DataFrame
) -> DataFrame:
    """'served' events of sessions (client_id, session_id, creation_time) in the latest experiment."""
    requests = sessions.join(latest_experiment(experiments), "client_id")
    return served_events(requests, events, variations)


def cookie_events(
    cookies: DataFrame, experiments: DataFrame, events: DataFrame, variations: DataFrame
) -> DataFrame:
    """Events that registering cookies adds: assign in the latest experiment, insert if absent."""
    requests = (
        cookies.groupBy("client_id", "session_id")
        .agg(F.min("creation_time").alias("creation_time"))
        .join(latest_experiment(experiments), "client_id")
    )
    served = assign(requests, events, variations).withColumn("event_name", F.lit("served"))
    return new_events(events, served)
