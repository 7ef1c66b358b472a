"""Region documents, visitors without a session, and scans of the product report."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from shoplens.functions.timeutil import ReportWindow
from shoplens.plans import product, visitor
from shoplens.schemas import conform
from shoplens.sources import documents, tables
from test_skew import as_if_big

WINDOW = ReportWindow("2024-01-01T00-00-00", "2024-02-01T00-00-00", "UTC")


def test_collections_are_valid_documents_of_all_regions(spark, table, tmp_path):
    names = ["North", "South", "East \"quoted\", é", "North"]
    shapes = [{"type": "Point", "coordinates": [i, -i]} for i in range(len(names))]
    reference = [{"type": "Feature", "id": f"0{i}", "region_name": n, "geometry": s} for i, (n, s) in enumerate(zip(names, shapes, strict=True))]
    reference.append({"type": "Feature", "id": "9", "region_name": "Nowhere", "geometry": None})
    (tmp_path / "regions.json").write_text(json.dumps(reference, indent=1))
    rows = [("a", "s1", "North", 1), ("a", "s2", None, 2), ("b", "s1", "South", 0)]
    joined = spark.createDataFrame(rows, "client_id string, session_id string, region string, orders long").select(
        "*", F.lit(1).cast("long").alias("rows"), (F.col("orders") * 10).cast("decimal(38,2)").alias("revenue")
    )
    by_region = visitor.sales_by_region(joined, documents.read_regions(spark, str(tmp_path / "regions.json")))
    path = tmp_path / "collections"
    visitor.write_feature_collections(visitor.region_features(by_region), str(path))
    for client, north in (("a", 10.0), ("b", 0.0)):
        (file,) = (path / f"client_id={client}").glob("*.txt")
        document = json.loads(file.read_text())
        assert document["type"] == "FeatureCollection"
        found = {f["id"]: f for f in document["features"]}
        assert sorted(found) == ["00", "01", "02", "03", "9"]
        assert [found[f"0{i}"]["geometry"] for i in range(4)] == shapes and found["9"]["geometry"] is None
        assert found["02"]["properties"]["name"] == names[2] and found["00"]["properties"]["total_sales"] == north
    back = visitor.read_feature_collections(spark, str(path))
    assert back.count() == 10
    assert json.loads(back.filter("id = '03' and client_id = 'a'").first().geometry) == shapes[3]
    # Equal features are all kept.
    twice = visitor.region_features(by_region)
    visitor.write_feature_collections(twice.unionByName(twice), str(tmp_path / "twice"))
    assert visitor.read_feature_collections(spark, str(tmp_path / "twice")).count() == 20


@pytest.fixture(scope="module")
def sessionless(spark, tmp_path_factory):
    """A third of all visitors and of all orders have no session."""
    root = str(tmp_path_factory.mktemp("sessionless"))
    base, i = spark.range(0, 30_000, 1, 8), F.col("id")
    session = F.when(i % 3 != 0, F.concat(F.lit("s"), (i % 4000).cast("string")))
    when = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    client = F.when(i % 2 == 0, "big").otherwise(F.concat(F.lit("t"), (i % 50).cast("string")))
    cart = F.when(i % 3 != 0, F.concat(F.lit("k"), (i % 4000).cast("string")))
    frames = {
        "visitors": base.select(client.alias("client_id"), session.alias("session_id"), F.concat(F.lit("d"), (i % 4).cast("string")).alias("device"), F.lit("b").alias("browser"), F.lit("o").alias("os"), F.lit("r").alias("region"), when.alias("creation_time")),
        "orders": base.select(client.alias("client_id"), i.alias("order_id"), cart.alias("cart_token"), F.lit(2).alias("variant_quantity"), F.lit("1.25").alias("variant_price"), when.alias("updated_at"), F.lit(True).alias("payment_status")),
        "cookies": base.filter(i % 3 != 0).select(client.alias("client_id"), session.alias("session_id"), cart.alias("cart_token"), when.alias("creation_time")),
    }
    for name, frame in frames.items():
        conform(frame, name).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in frames}


def test_visitors_without_a_session_meet_orders_without_one(spark, sessionless, table):
    clients = table("clients", [])
    with as_if_big(spark):
        joined = visitor.visitor_orders(sessionless["visitors"], sessionless["orders"], sessionless["cookies"], clients, WINDOW, match_null_sessions=True)
        got = joined.filter("session_id is null").groupBy("client_id").agg(F.max("orders").alias("orders"), F.max("revenue").alias("revenue"), F.count(F.lit(1)).alias("n"))
        got = {r.client_id: (r.orders, float(r.revenue), r.n) for r in got.collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    i = range(30_000)
    window = [k for k in i if k * 60 > 0 and k * 60 < 31 * 86400 and k % 3 == 0]
    for name in ("big", "t1"):
        mine = [k for k in window if (k % 2 == 0 and name == "big") or (k % 2 == 1 and name == f"t{k % 50}")]
        assert got[name][:2] == (len(mine), 2.5 * len(mine))
        assert got[name][2] == len({k % 4 for k in mine}), "one row per attributes, whatever the rows"
    # Both sides are summed per session, with a partial step, before they meet.
    sides = plan.split("Join", 1)[1]
    assert sides.count("HashAggregate") >= 4


def test_the_worst_products_scan_each_fact_table_once(spark, sessionless, table, tmp_path):
    when = {"creation_time": "2024-01-05T00:00:00Z"}
    tables.append_table(table("visits", [{"client_id": "a", "session_id": s, "event_name": "product", "url": "/products/h", **when} for s in "xyz"]), str(tmp_path), "visits")
    orders = [{"client_id": "a", "order_id": 1, "product_id": 7, "variant_id": 1, "variant_quantity": 1, "variant_price": "2.00", "updated_at": "2024-01-06T00:00:00Z", "payment_status": True}]
    tables.append_table(table("orders", orders), str(tmp_path), "orders")
    products = table("products", [{"client_id": c, "product_id": 7, "product_title": "T", "product_handle": "h", "tags": "x"} for c in "ab"])
    rows = product.product_worst_by_tag(products, tables.read_table(spark, str(tmp_path), "visits"), tables.read_table(spark, str(tmp_path), "orders"), table("clients", []), WINDOW)
    assert rows_of(rows, "client_id", "status", "conversion_percentage") == [("a", "enough", 33.33), ("b", "not_enough", None)]
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2
