"""One tenant, session and cart hold a large share of all rows, and nothing is small enough to broadcast."""

import contextlib

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators import experiments, lookups, sales
from shoplens.plans import funnel, landing, visitor
from shoplens.schemas import conform

WINDOW = ReportWindow("2024-01-02T00-00-00", "2024-01-30T00-00-00")

BIG_DATA = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextlib.contextmanager
def as_if_big(spark):
    before = {k: spark.conf.get(k, None) for k in BIG_DATA}
    try:
        for k, v in BIG_DATA.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Stored in several files, so that the hot partition has several map outputs to split by."""
    root = str(tmp_path_factory.mktemp("hot"))
    base = spark.range(0, 60000, 1, 8)
    i = F.col("id")
    client = F.when(i % 3 == 0, "big").otherwise(F.concat(F.lit("t"), (i % 200).cast("string")))
    session = F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.when(i % 3 == 1, F.concat(F.lit("s"), (i % 7).cast("string"))).otherwise(F.concat(F.lit("s"), i.cast("string")))
    )
    when = F.timestamp_seconds(F.lit(1704067200) + i * 40)
    page = F.element_at(F.array(*[F.lit(p) for p in ("home", "collection", "product", "cart")]), (i % 4 + 1).cast("int"))
    cart = F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "hot").otherwise(F.concat(F.lit("k"), (i % 9000).cast("string")))
    frames = {
        "visits": base.select(client.alias("client_id"), session.alias("session_id"), page.alias("event_name"), when.alias("creation_time"), F.lit("/products/x").alias("url")),
        "events": base.select(
            client.alias("client_id"), session.alias("session_id"), F.lit("e").alias("experiment_id"),
            F.concat(F.lit("v"), (i % 2).cast("string")).alias("variation_id"),
            F.when(i % 3 == 0, "clicked").otherwise("served").alias("event_name"), when.alias("creation_time"),
        ),
        "orders": base.select(
            client.alias("client_id"), (i % 20000).alias("order_id"), cart.alias("cart_token"), F.lit(1).alias("product_id"),
            (i % 5).alias("variant_id"), F.lit(2).alias("variant_quantity"), F.lit("1.25").alias("variant_price"),
            when.alias("updated_at"), (i % 6 != 0).alias("payment_status"),
        ),
        "cookies": base.select(client.alias("client_id"), session.alias("session_id"), cart.alias("cart_token"), when.alias("creation_time")),
        "visitors": base.select(
            client.alias("client_id"), session.alias("session_id"), F.concat(F.lit("d"), (i % 2).cast("string")).alias("device"),
            F.lit("b").alias("browser"), F.lit("o").alias("os"), when.alias("creation_time"),
        ),
    }
    out = {}
    for name, df in frames.items():
        conform(df, name).write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    tenants = out["visits"].select("client_id").distinct()
    conform(tenants.withColumn("client_timezone", F.lit("Asia/Kolkata")), "clients").write.parquet(f"{root}/clients")
    conform(
        tenants.withColumn("experiment_id", F.lit("e")).withColumn("creation_time", F.lit("2024-01-05").cast("timestamp")), "experiments"
    ).write.parquet(f"{root}/experiments")
    return {**out, **{n: spark.read.parquet(f"{root}/{n}") for n in ("clients", "experiments")}}


REPORTS = {
    "funnel": lambda d: funnel.shop_funnel(d["visits"], d["orders"], d["clients"], WINDOW),
    "landing": lambda d: landing.landing_page_conversion(d["visits"], d["orders"], d["clients"], WINDOW),
    "sales": lambda d: sales.attributed_sales(d["orders"], d["cookies"], d["events"], lookups.experiment_start(d["experiments"])),
    "counts": lambda d: experiments.variation_event_counts(d["events"]),
    "visitors": lambda d: visitor.sales_by_dimension(
        visitor.visitor_orders(d["visitors"], d["orders"], d["cookies"], d["clients"], WINDOW, match_null_sessions=True)
    ),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_same_result_without_broadcast(spark, hot, name):
    normal = rows_of(REPORTS[name](hot))
    assert normal
    with as_if_big(spark):
        assert rows_of(REPORTS[name](hot)) == normal


def test_a_hot_tenant_is_split(spark, hot):
    with as_if_big(spark):
        df = REPORTS["funnel"](hot)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in final


def test_hot_groups_shrink_before_the_shuffle(spark, hot):
    """The sessionless third of the page views reaches the shuffle as one row per task and tenant."""
    from shoplens.operators.traffic import first_touch

    plan = first_touch(hot["visits"])._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[1]
    assert "partial_min" in below and "HashAggregate" in below and "SortAggregate" not in plan


def test_a_task_reads_a_bounded_share(spark):
    # Sorts and hash tables take some 25 times the shuffled bytes; 64 MB, the default, came to 1.6 GB a task.
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "24m"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes") == "96m"
