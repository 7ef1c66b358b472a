"""Visitor sales by device, browser, operating system and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.ratio import mean_damped, percent_damped
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators.sales import order_totals, session_orders

# Fixed visitor attributes the report breaks sales down by.
DIMENSIONS = ["device", "browser", "os"]
#: Parts in which tenants meet the region reference: at least so many, and more for a large reference.
REGION_SLOTS, REGIONS_PER_SLOT = 32, 256
MEASURES = ["session_count", "visitor_count", "sales_conversion_count", "order_count"]


def visitor_orders(
    visitors: DataFrame,
    orders: DataFrame,
    cookies: DataFrame,
    clients: DataFrame,
    window: ReportWindow,
    per_cookie: bool = False,
    match_null_sessions: bool = False,
) -> DataFrame:
    """Visitor rows per session and attributes, with the orders and revenue of that session.

    Both sides are unique in the join key columns they bring, so a session with many visitor
    rows and many orders stays one row per attribute combination. ``match_null_sessions`` lets
    visitors without a session meet orders without one.
    """
    seen = (
        window.restrict(visitors, "creation_time", clients)
        .groupBy("client_id", "session_id", *DIMENSIONS, "region")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    sold = session_orders(order_totals(window.restrict(orders, "updated_at", clients), cookies, per_cookie))
    if not match_null_sessions:
        sold = sold.filter(F.col("session_id").isNotNull())
    sold = sold.withColumnRenamed("client_id", "_client").withColumnRenamed("session_id", "_session")
    same = (F.col("client_id") == F.col("_client")) & (
        F.col("session_id").eqNullSafe(F.col("_session"))
        if match_null_sessions
        else F.col("session_id") == F.col("_session")
    )
    return seen.join(sold, same, "left").select(
        "client_id",
        "session_id",
        *DIMENSIONS,
        "region",
        "rows",
        F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"),
        F.coalesce("revenue", F.lit(0).cast("decimal(38,2)")).alias("revenue"),
    )


def _measures(per_session: DataFrame, key: list[str]) -> DataFrame:
    """Report measures from rows that are unique in key and session.

    An order belongs to one session, so orders add up over sessions without a distinct count.
    Revenue counts once per attribute combination of the session. ``session_count`` counts
    visitor rows times orders.
    """
    buyer = F.col("orders") > 0
    return per_session.groupBy(*key).agg(
        F.sum(F.col("rows") * F.greatest(F.col("orders"), F.lit(1))).alias("session_count"),
        F.count(F.lit(1)).alias("visitor_count"),
        F.sum(buyer.cast("int")).alias("sales_conversion_count"),
        F.sum("orders").alias("order_count"),
        F.sum("revenue").cast("decimal(38,2)").alias("total_sales"),
    )


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "sales_conversion", percent_damped(F.col("sales_conversion_count"), F.col("visitor_count"))
    ).withColumn("avg_order_value", mean_damped(F.col("total_sales"), F.col("order_count"))).withColumn(
        "total_sales", F.col("total_sales").cast("double")
    )


def _per_session(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key, "session_id").agg(
        F.sum("rows").alias("rows"),
        F.max("orders").alias("orders"),
        F.sum("revenue").cast("decimal(38,2)").alias("revenue"),
    )


def sales_by_dimension(joined: DataFrame) -> DataFrame:
    """client_id, dimension, value and measures, from ``visitor_orders``.

    One grouping-sets pass reduces the rows to one per attribute value and session.
    """
    sets = [["client_id", "session_id", d] for d in DIMENSIONS]
    columns = ["client_id", "session_id", *DIMENSIONS]
    per_session = (
        joined.groupingSets(
            [[F.col(c) for c in s] for s in sets],
            *[F.col(c) for c in columns],
        )
        .agg(
            F.grouping_id(*columns).alias("_set"),
            F.sum("rows").alias("rows"),
            F.max("orders").alias("orders"),
            F.sum("revenue").cast("decimal(38,2)").alias("revenue"),
        )
    )
    # The bit of a dimension is 0 in the set it belongs to: 011, 101 and 110.
    bits = {d: sum(1 << j for j in range(len(DIMENSIONS)) if j != len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS)}
    name = F.coalesce(*[F.when(F.col("_set") == b, F.lit(d)) for d, b in bits.items()])
    value = F.coalesce(*[F.when(F.col("_set") == b, F.col(d)) for d, b in bits.items()])
    labelled = per_session.select(
        "client_id", "session_id", name.alias("dimension"), value.alias("value"), "rows", "orders", "revenue"
    ).filter(F.col("value").isNotNull())
    return _rates(_measures(labelled, ["client_id", "dimension", "value"]))


def sales_by_region(joined: DataFrame, regions: DataFrame) -> DataFrame:
    """Measures of every reference region for each tenant with visitors, zero where none.

    The regions are dealt into slots that every tenant meets, so the grid is an ordinary join of
    as many parts as there are slots, whatever the size of either side; their number grows with the regions.
    """
    key = ["client_id", "region"]
    found = _measures(_per_session(joined.filter(F.col("region").isNotNull()), key), key)
    many = F.greatest(F.lit(REGION_SLOTS), F.ceil(F.count(F.lit(1)) / REGIONS_PER_SLOT)).cast("int")
    # One partial count per task; no row for no region.
    counted = regions.groupBy(F.lit(0).alias("_all")).agg(many.alias("n")).select("n")
    n_slots = F.coalesce(counted.scalar(), F.lit(REGION_SLOTS))
    tenants = joined.select("client_id").distinct().withColumn("_slots", F.sequence(F.lit(0), n_slots - 1))
    tenants = tenants.select("client_id", F.explode("_slots").alias("_slot"))
    slot = F.pmod(F.xxhash64("region_name", "id"), n_slots).cast("int").alias("_slot")
    reference = regions.select("region_name", "id", "type", "geometry", slot)
    grid = tenants.join(reference, "_slot").drop("_slot")
    zero = {c: 0 for c in MEASURES}
    filled = (
        grid.join(found.withColumnRenamed("region", "region_name"), ["client_id", "region_name"], "left")
        .na.fill(zero)
        .withColumn("total_sales", F.coalesce("total_sales", F.lit(0).cast("decimal(38,2)")))
    )
    return _rates(filled)


def region_features(by_region: DataFrame) -> DataFrame:
    """One GeoJSON feature text per tenant and region; the geometry is embedded as it came."""
    properties = F.struct(
        F.col("region_name").alias("name"),
        "session_count",
        "visitor_count",
        "total_sales",
        "sales_conversion_count",
        "order_count",
        "sales_conversion",
        "avg_order_value",
    )
    head = F.to_json(F.struct("type", "id", properties.alias("properties")))
    body = F.concat(
        F.expr("substring(_head, 1, length(_head) - 1)"),
        F.lit(',"geometry":'),
        F.coalesce("geometry", F.lit("null")),
        F.lit("}"),
    )
    return by_region.withColumn("_head", head).select("client_id", "region_name", body.alias("feature"))


def write_feature_collections(features: DataFrame, path: str) -> None:
    """One GeoJSON document per tenant, a feature collection, in folders of the tenants.

    A tenant's features follow each other in sorted order in one task, which writes them as they
    come; nothing gathers them. They go by region name, equal ones side by side.
    """
    key = F.coalesce("region_name", F.lit("")).alias("key")
    unique = features.groupBy("client_id", key, "feature").agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = unique.groupBy("client_id").agg(F.min(F.struct("key", "feature")).alias("first"))
    text = F.array_join(F.array_repeat("feature", F.col("n")), ",")
    is_first = F.struct("key", "feature") == F.col("first")
    lines = unique.join(first, "client_id").select(
        "client_id", F.lit(1).alias("part"), "key", F.when(is_first, text).otherwise(F.concat(F.lit(","), text)).alias("value")
    )

    def edge(part: int, value: str) -> DataFrame:
        return first.select("client_id", F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(value).alias("value"))

    lines = lines.unionByName(edge(0, '{"type":"FeatureCollection","features":[')).unionByName(edge(2, "]}"))
    # The first feature has no comma and has to come first among its equals in name.
    order = ["client_id", "part", "key", F.col("value").startswith(","), "value"]
    lines = lines.repartitionByRange("client_id").sortWithinPartitions(*order)
    lines.select("client_id", "value").write.partitionBy("client_id").text(path)


# A stored collection; each geometry stays the JSON text it came as.
COLLECTION = (
    "client_id string, type string, features array<struct<type: string, id: string, geometry: string,"
    " properties: struct<name: string, session_count: bigint, visitor_count: bigint, total_sales: double,"
    " sales_conversion_count: bigint, order_count: bigint, sales_conversion: double, avg_order_value: double>>>"
)


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """The features of stored collections (client_id, document, type, id, geometry, properties)."""
    documents = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    each = documents.select("client_id", F.col("type").alias("document"), F.explode("features").alias("f"))
    return each.select("client_id", "document", "f.*")
