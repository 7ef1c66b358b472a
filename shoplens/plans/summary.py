"""Verdict on each experiment: best variation, confidence, and what is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.stats import chi_square_confidence, pooled_chi_square, required_sample_size
from shoplens.operators.experiments import experiment_span

EXPERIMENT = ["client_id", "experiment_id"]


def ab_evaluation(goals: DataFrame) -> DataFrame:
    """One row per experiment with its best arm, compared with every other arm.

    ``goals`` is the goal table (or the conversion table): one row per arm. Confidence is the
    product over the other arms of one minus the chi-square tail; it is null when any
    comparison is undefined, for example against an arm without visitors.
    """
    rate = F.col("goal_conversion_count") / (F.col("num_visitor") + F.lit(0.01))
    best = F.struct(
        (-F.col("rate")).alias("order"),
        "variation_id",
        "variation_name",
        F.col("goal_conversion_count").alias("c"),
        F.col("num_visitor").alias("n"),
    )
    # A window instead of a self-join: the counts below are computed once.
    arms = goals.withColumn("rate", rate).withColumn(
        "best", F.min(best).over(Window.partitionBy(*EXPERIMENT))
    )
    other = F.col("variation_id") != F.col("best.variation_id")
    x = pooled_chi_square(F.col("best.c"), F.col("best.n"), F.col("goal_conversion_count"), F.col("num_visitor"))
    totals = (
        arms.withColumn("x", F.when(other, x))
        .withColumn("confidence", chi_square_confidence("x"))
        .groupBy(*EXPERIMENT)
        .agg(
            F.any_value("best").alias("best"),
            F.count(F.lit(1)).alias("arms"),
            F.sum("num_session").alias("sessions"),
            F.sum("num_visitor").alias("visitors"),
            F.product("confidence").alias("confidence"),
            F.sum("x").alias("chi_square_sum"),
            F.max(other & F.col("x").isNull()).alias("undefined"),
            F.sum(F.when(other, F.col("rate").cast("decimal(38,18)"))).alias("other_rates"),
        )
    )
    best_rate = -F.col("best.order")
    mean_other = F.try_divide(F.col("other_rates").cast("double"), F.col("arms") - 1)
    defined = ~F.col("undefined")
    return totals.select(
        *EXPERIMENT,
        "arms",
        "sessions",
        "visitors",
        F.col("best.variation_id").alias("best_variation_id"),
        F.col("best.variation_name").alias("best_variation"),
        best_rate.alias("best_rate"),
        F.when(defined, F.col("chi_square_sum")).alias("chi_square_sum"),
        F.when(defined, F.col("confidence")).alias("confidence"),
        F.when(best_rate > 0, (best_rate - mean_other) / best_rate).alias("betterness"),
        required_sample_size("arms").alias("required_sessions"),
    )


def experiment_summary(
    experiments: DataFrame,
    events: DataFrame,
    goals: DataFrame,
    confidence_cap: float = 99.99,
    confidence_threshold: float = 95.0,
) -> DataFrame:
    """Status of every experiment: insufficient, pending, no_clear_winner or winner.

    ``goals`` is the goal table. Confidence is capped before it is compared, and a
    sample that is exactly complete still counts as pending.
    """
    evaluated = experiment_span(experiments, events).join(ab_evaluation(goals), EXPERIMENT, "left")
    missing = F.col("required_sessions") - F.col("sessions")
    per_day = F.try_divide(F.col("sessions"), F.col("num_hour") + 1) * 24
    days = F.try_divide(F.col("remaining_sessions"), per_day)
    confidence = F.round(F.least(F.col("confidence") * 100, F.lit(confidence_cap)), 2)
    enough = (
        (F.coalesce("visitors", F.lit(0)) > 0)
        & F.col("start_time").isNotNull()
        & F.col("end_time").isNotNull()
        & (F.col("arms") > 1)
    )
    rows = (
        evaluated.withColumn("remaining_sessions", missing)
        .withColumn("confidence_percentage", F.when(F.col("confidence").isNotNull(), confidence))
        .withColumn(
            "status",
            F.when(~enough, "insufficient")
            .when(F.col("remaining_sessions") >= 0, "pending")
            .when(F.col("confidence_percentage") > confidence_threshold, "winner")
            .otherwise("no_clear_winner"),
        )
    )
    known = F.col("status") != "insufficient"
    pending = F.col("status") == "pending"
    return rows.select(
        *EXPERIMENT,
        "status",
        F.when(known, F.col("best_variation_id")).alias("best_variation_id"),
        F.when(known, F.col("best_variation")).alias("best_variation"),
        F.when(known, F.round(F.col("betterness") * 100, 2)).alias("betterness_percentage"),
        F.when(known & ~pending, F.col("confidence_percentage")).alias("confidence_percentage"),
        F.when(pending, F.col("remaining_sessions")).alias("remaining_sessions"),
        F.when(pending, F.floor(days).cast("bigint") + 1).alias("remaining_days"),
        F.when(F.col("status").isin("insufficient", "pending"), "continue").otherwise("stop").alias("recommendation"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """The verdict as plain sentences."""
    lead = F.format_string("%s leads by %.2f%%.", "best_variation", "betterness_percentage")
    return summary.select(
        *EXPERIMENT,
        F.when(F.col("status") == "insufficient", "Too few visitors so far.").otherwise(lead).alias("summary"),
        F.when(F.col("status") == "insufficient", "Too few visitors so far.")
        .when(
            F.col("status") == "pending",
            F.format_string("About %d more sessions are needed, some %d days.", "remaining_sessions", "remaining_days"),
        )
        .when(
            F.col("status") == "winner",
            F.format_string("%s wins with %.2f%% confidence.", "best_variation", "confidence_percentage"),
        )
        .otherwise("The sample is complete and no variation stands out.")
        .alias("conclusion"),
        "recommendation",
    )
