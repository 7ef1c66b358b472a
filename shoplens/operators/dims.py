"""Rows of new tenants, experiments and variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.timeutil import epoch_to_time
from shoplens.schemas import conform


def stable_id(*parts: str) -> Column:
    """A key from the natural columns: a re-run task or a repeated load gives the same one."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))


def new_clients(raw: DataFrame) -> DataFrame:
    """Tenant rows from a sign-up batch with epoch seconds."""
    return conform(raw.withColumn("creation_time", epoch_to_time(F.col("creation_timestamp"))), "clients")


def new_experiments(raw: DataFrame) -> DataFrame:
    """Experiment rows from (client_id, experiment_name, page_type, ..., epoch seconds)."""
    created = epoch_to_time(F.col("creation_time"))
    updated = epoch_to_time(F.col("last_updation_time"))
    return conform(
        raw.select(
            stable_id("client_id", "experiment_name", "creation_time").alias("experiment_id"),
            "client_id",
            "experiment_name",
            "page_type",
            "experiment_type",
            "status",
            created.alias("creation_time"),
            updated.alias("last_updation_time"),
            created.alias("start_time"),
            created.alias("end_time"),
        ),
        "experiments",
    )


def new_variations(raw: DataFrame) -> DataFrame:
    """Variation rows from (client_id, experiment_id, variation_name, traffic_percentage)."""
    return conform(
        raw.withColumn("variation_id", stable_id("client_id", "experiment_id", "variation_name")),
        "variations",
    )


def append_rows(raw: DataFrame, table: str) -> DataFrame:
    """Registrations with epoch seconds as rows of an append-only table, duplicates kept."""
    return conform(raw.withColumn("creation_time", epoch_to_time(F.col("creation_time"))), table)
