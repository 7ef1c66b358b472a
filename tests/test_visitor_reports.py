import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators import sales
from shoplens.plans import visitor

WINDOW = ReportWindow("2024-01-01T00-00-00", "2024-01-31T00-00-00", "UTC")
T = "2024-01-10T00:00:00Z"


def shop_rows(seed):
    rnd = random.Random(seed)
    maybe = lambda v: None if rnd.random() < 0.15 else v

    def session():
        return "s0" if rnd.random() < 0.34 else f"s{rnd.randrange(8)}"

    visitors = [
        {
            "client_id": "k",
            "session_id": maybe(session()),
            "device": rnd.choice(["phone", "desk"]),
            "browser": maybe(rnd.choice("xyz")),
            "os": rnd.choice("mn"),
            "region": maybe(rnd.choice(["North", "South"])),
            "creation_time": T,
        }
        for _ in range(60)
    ]
    cookies = [
        {"client_id": "k", "session_id": maybe(session()), "cart_token": maybe(f"c{rnd.randrange(9)}"), "creation_time": T}
        for _ in range(25)
    ]
    orders = [
        {
            "client_id": "k",
            "order_id": (oid := rnd.randrange(1, 20)),
            "cart_token": f"c{oid % 12}" if oid % 5 else None,
            "product_id": 1,
            "variant_id": 1,
            "variant_quantity": rnd.randrange(1, 4),
            "variant_price": "2.50",
            "updated_at": T,
            "payment_status": rnd.random() < 0.8,
        }
        for _ in range(70)
    ]
    return visitors, cookies, orders


def brute_force(visitors, cookies, orders, per_cookie, match_null, dimension):
    """The report row by row: join, drop duplicate rows, group."""
    carts = {}
    for c in cookies:
        if c["cart_token"] is not None:
            carts.setdefault(c["cart_token"], []).append(c["session_id"])
    totals = {}
    for o in orders:
        if o["payment_status"]:
            sessions = carts.get(o["cart_token"], []) if o["cart_token"] is not None else []
            known = [s for s in sessions if s is not None]
            entry = totals.setdefault(o["order_id"], [set(), 0.0])
            entry[0].update(known)
            entry[1] += o["variant_quantity"] * 2.5 * (max(1, len(sessions)) if per_cookie else 1)
    by_session = {}
    for oid, (known, value) in totals.items():
        by_session.setdefault(min(known) if known else None, []).append((oid, value))
    joined = []
    for v in visitors:
        hits = by_session.get(v["session_id"], []) if match_null or v["session_id"] is not None else []
        for oid, value in hits or [(None, 0.0)]:
            joined.append((v["session_id"], v["device"], v["browser"], v["os"], v["region"], oid, value))
    col = {"device": 1, "browser": 2, "os": 3, "region": 4}[dimension]
    out = {}
    for value in {r[col] for r in joined} - {None}:
        rows = [r for r in joined if r[col] == value]
        sold = {r for r in joined if r[col] == value and r[5] is not None}
        total = round(sum(r[6] for r in sold), 2)
        visitors_n, buyers, n = len({r[0] for r in rows}), len({r[0] for r in sold}), len({r[5] for r in sold})
        out[value] = (
            len(rows), visitors_n, buyers, n, total,
            min(100.0, round(buyers * 100 / (visitors_n + 0.01), 2)), round(total / (n + 0.01), 2),
        )
    return out


@pytest.mark.parametrize("seed,per_cookie,match_null", [(1, False, False), (2, True, False), (3, False, True), (4, True, True)])
def test_sales_by_dimension_and_region(table, seed, per_cookie, match_null):
    v, c, o = shop_rows(seed)
    clients = table("clients", [{"client_id": "k", "client_timezone": "UTC"}])
    joined = visitor.visitor_orders(
        table("visitors", v), table("orders", o), table("cookies", c), clients, WINDOW, per_cookie, match_null
    )
    got = {}
    for r in visitor.sales_by_dimension(joined).collect():
        got.setdefault(r.dimension, {})[r.value] = tuple(r)[3:8] + (r.sales_conversion, r.avg_order_value)
    regions = table("regions", [{"type": "Feature", "id": str(i), "region_name": n, "geometry": '{"type":"Point"}'} for i, n in enumerate(["North", "South", "West"])])
    by_region = visitor.sales_by_region(joined, regions)
    columns = ["session_count", "visitor_count", "sales_conversion_count", "order_count", "total_sales", "sales_conversion", "avg_order_value"]
    got["region"] = {r.region_name: tuple(r[c] for c in columns) for r in by_region.collect()}
    for d in ("device", "browser", "os"):
        assert got[d] == brute_force(v, c, o, per_cookie, match_null, d), d
    want = brute_force(v, c, o, per_cookie, match_null, "region")
    assert got["region"] == {**want, "West": (0, 0, 0, 0, 0.0, 0.0, 0.0)}

    feature = json.loads(visitor.region_features(by_region).filter("region_name = 'North'").first().feature)
    assert feature["type"] == "Feature" and feature["geometry"] == {"type": "Point"}
    assert feature["properties"]["name"] == "North"
    assert feature["properties"]["visitor_count"] == want["North"][1]


def test_every_region_of_a_long_reference_is_listed(table):
    clients = table("clients", [{"client_id": "k", "client_timezone": "UTC"}])
    joined = visitor.visitor_orders(
        table("visitors", [{"client_id": "k", "session_id": "s", "creation_time": T}]), table("orders", []), table("cookies", []), clients, WINDOW
    )
    regions = table("regions", [{"region_name": f"r{n}", "id": str(n), "type": "Feature"} for n in range(300)])
    assert visitor.sales_by_region(joined, regions).select("region_name").distinct().count() == 300


def test_orders_without_a_cart_stay(table):
    orders = table(
        "orders",
        [
            {"client_id": "k", "order_id": i, "cart_token": t, "product_id": 1, "variant_id": 1, "variant_quantity": 2,
             "variant_price": "3.00", "updated_at": T, "payment_status": True}
            for i, t in [(1, "c1"), (2, None), (3, "c9"), (4, None)]
        ],
    )
    cookies = table("cookies", [{"client_id": "k", "session_id": s, "cart_token": t, "creation_time": T} for s, t in [("s2", "c1"), ("s1", "c1"), ("s1", "c1"), ("s3", None), ("s4", "2")]])
    totals = sales.order_totals(orders, cookies).withColumn("total_order_value", F.col("total_order_value").cast("double"))
    assert rows_of(totals, "order_id", "session_id", "total_order_value") == [(1, "s1", 6.0), (2, None, 6.0), (3, None, 6.0), (4, None, 6.0)]
    assert rows_of(sales.order_sessions(orders, cookies), "order_id", "sessions") == [(1, 2), (2, 0), (3, 0), (4, 0)]
    per_cookie = sales.order_totals(orders, cookies, per_cookie=True).filter("order_id = 1").first()
    assert float(per_cookie.total_order_value) == 18.0
