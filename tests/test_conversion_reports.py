import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators import feeds
from shoplens.plans import funnel, landing, product

WINDOW = ReportWindow("2020-05-28T00-00-01", "2020-06-28T23-59-59", "Asia/Kolkata")
WIDE = ReportWindow("2019-05-27T00-00-01", "2021-07-28T23-59-59")


@pytest.fixture()
def data(spark, table):
    """Tables of the staged tests: empty, products, plus orders, plus visits."""
    clients = table("clients", [{"client_id": shop.CLIENT, "client_timezone": "Asia/Kolkata"}])

    def stage(n):
        orders = feeds.order_batch(
            shop.pages(spark, "orders", shop.order_page()), shop.pages(spark, "checkouts", shop.checkout_page())
        )
        products = feeds.product_rows(shop.pages(spark, "products", shop.product_page()))
        return {
            "clients": clients,
            "products": products if n >= 1 else table("products", []),
            "orders": orders if n >= 2 else table("orders", []),
            "visits": table("visits", shop.visit_rows() if n >= 3 else []),
        }

    return stage


def funnel_of(d):
    rows = funnel.shop_funnel(d["visits"], d["orders"], d["clients"], WINDOW).orderBy("step_id").collect()
    churn = funnel.funnel_churn(d["visits"], d["orders"], d["clients"], WINDOW).first()
    assert [r.page for r in rows] == funnel.PAGES
    return [r.visitor_count for r in rows], [r.percentage for r in rows], (churn.status, churn.page, churn["drop"])


def test_funnel(data):
    none = ("not_enough", None, None)
    assert funnel_of(data(1)) == ([0] * 6, [0.0] * 6, none)
    assert funnel_of(data(2)) == ([0, 0, 0, 0, 7, 5], [0, 0, 0, 0, 100.0, 71.43], none)
    assert funnel_of(data(3)) == (
        [24, 24, 19, 11, 7, 5],
        [100.0, 100.0, 79.17, 45.83, 29.17, 20.83],
        ("enough", "Product Page", 33.34),
    )


def test_funnel_second_step_can_lose_most(data, table):
    d = data(0)
    steps = ["home", "home", "home", "collection", "collection", "product", "cart"]
    d["visits"] = table(
        "visits",
        [
            {"client_id": shop.CLIENT, "session_id": f"s{i}", "event_name": e, "creation_time": "2020-06-01T00:00:00Z"}
            for i, e in enumerate(steps)
        ],
    )
    assert funnel_of(d) == ([3, 2, 1, 1, 0, 0], [100.0, 66.67, 33.33, 33.33, 0.0, 0.0], ("enough", "Collection Page", 33.34))


def test_funnel_union_agrees(data):
    d = data(3)
    args = (d["visits"], d["orders"], d["clients"], WINDOW)
    one_pass = funnel.shop_funnel(*args).drop("percentage")
    assert rows_of(one_pass, "step_id", "visitor_count") == rows_of(
        funnel.shop_funnel_union(*args), "step_id", "visitor_count"
    )


def landing_of(d):
    rows = landing.landing_page_conversion(d["visits"], d["orders"], d["clients"], WIDE).orderBy("page_id").collect()
    worst = landing.landing_worst(d["visits"], d["orders"], d["clients"], WIDE).first()
    return (
        [r.non_conversion_count for r in rows],
        [r.conversion_count for r in rows],
        [r.conversion_percentage for r in rows],
        (worst.status, worst.page),
    )


def test_landing_pages(data):
    assert landing_of(data(1)) == ([0] * 3, [0] * 3, [0.0] * 3, ("not_enough", None))
    assert landing_of(data(2)) == ([0] * 3, [6, 2, 2], [100.0] * 3, ("enough", "Home Page"))
    assert landing_of(data(3)) == ([18, 4, 2], [6, 2, 2], [25.0, 33.33, 50.0], ("enough", "Home Page"))


def products_of(d):
    args = (d["products"], d["visits"], d["orders"], d["clients"], WINDOW)
    by_tag = {}
    for r in product.product_conversion_by_tag(*args).orderBy("product_handle").collect():
        by_tag.setdefault(r.tag, []).append(
            (r.product_title, r.non_conversion_count, r.conversion_count, r.conversion_percentage)
        )
    worst = {r.tag: (r.status, r.product_title) for r in product.product_worst_by_tag(*args).collect()}
    tags = [r.tag for r in product.product_tags(d["products"]).orderBy("tag_rank").collect()]
    return tags, by_tag, worst


def test_products(data):
    assert products_of(data(0)) == ([], {}, {})

    tags, by_tag, worst = products_of(data(1))
    assert tags == ["sale", "wool", "no-tag"]
    assert [r[1:] for r in by_tag["sale"]] == [(0, 0, 0.0)] * 2
    assert set(worst.values()) == {("not_enough", None)}

    # Products 1 and 2 are in three paid orders each, 3 and 4 in two.
    _, by_tag, worst = products_of(data(2))
    assert [r[1:] for r in by_tag["sale"]] == [(0, 3, 100.0), (0, 3, 100.0)]
    assert worst["sale"] == ("enough", "title_1")

    # Seven sessions saw product 1, six each 2 and 3, none 4.
    _, by_tag, worst = products_of(data(3))
    assert by_tag["sale"] == [("title_1", 4, 3, 42.86), ("title_2", 3, 3, 50.0)]
    assert by_tag["wool"] == [("title_1", 4, 3, 42.86), ("title_3", 4, 2, 33.33)]
    assert by_tag["no-tag"] == [("title_4", 0, 2, 100.0)]
    assert worst == {"sale": ("enough", "title_1"), "wool": ("enough", "title_3"), "no-tag": ("enough", "title_4")}


def test_first_touch_keeps_a_sessionless_group_and_breaks_ties(spark, table):
    from shoplens.operators.traffic import first_touch

    rows = [
        ("s1", "product", "2020-01-02T00:00:00Z"),
        ("s1", "home", "2020-01-02T00:00:00Z"),
        ("s1", "cart", "2020-01-01T00:00:00Z"),
        ("s2", "product", "1969-12-31T23:59:59.5Z"),
        (None, "home", "2020-01-03T00:00:00Z"),
        (None, "collection", "2020-01-03T00:00:00.000001Z"),
    ]
    visits = table(
        "visits", [{"client_id": "a", "session_id": s, "event_name": e, "creation_time": t} for s, e, t in rows]
    )
    assert rows_of(first_touch(visits).withColumn("t", F.date_format("first_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")), "session_id", "event_name", "t") == [
        (None, "home", "2020-01-03 00:00:00.000000"),
        ("s1", "home", "2020-01-02 00:00:00.000000"),
        ("s2", "product", "1969-12-31 23:59:59.500000"),
    ]
