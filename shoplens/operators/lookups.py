"""Lookups on the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.timeutil import experiment_date_text, local_date_text


def client_details(clients: DataFrame) -> DataFrame:
    """Tenant rows with the sign-up date as text."""
    return clients.select(
        "client_id",
        "full_name",
        "company_name",
        "disabled",
        "shopify_app_eg_url",
        "client_timezone",
        local_date_text(F.col("creation_time"), "UTC").alias("creation_time"),
    )


def client_ids(clients: DataFrame) -> DataFrame:
    return clients.select("client_id")


def experiment_list(experiments: DataFrame) -> DataFrame:
    """Experiments of every tenant with dashboard dates."""
    return experiments.select(
        "client_id",
        "experiment_id",
        "experiment_name",
        "status",
        "page_type",
        "experiment_type",
        experiment_date_text(F.col("creation_time")).alias("creation_time"),
        experiment_date_text(F.col("last_updation_time")).alias("last_updation_time"),
    )


def variation_list(variations: DataFrame) -> DataFrame:
    return variations.select("client_id", "experiment_id", "variation_id", "variation_name")


def experiment_start(experiments: DataFrame) -> DataFrame:
    return experiments.select("client_id", "experiment_id", F.col("creation_time").alias("start_time"))


def first_start(starts: DataFrame) -> DataFrame:
    """When the first of all experiments began, one value: the least of one partial minimum per task; no row for none."""
    return starts.groupBy(F.lit(0).alias("_all")).agg(F.min("start_time").alias("first")).select("first")


def latest_experiment(experiments: DataFrame) -> DataFrame:
    """Per tenant the experiment updated last; the smallest id wins a tie."""
    newest_first = F.struct(
        (-F.unix_micros("last_updation_time")).alias("age"), F.col("experiment_id").alias("id")
    )
    return (
        experiments.filter(F.col("last_updation_time").isNotNull())
        .groupBy("client_id")
        .agg(F.min(newest_first).getField("id").alias("experiment_id"))
    )


def tagged_union(*branches: DataFrame) -> DataFrame:
    """SQL UNION of branches: appended, then without duplicate rows."""
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out.distinct()
