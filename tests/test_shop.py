"""From landed pages through the sync jobs to every report."""

import datetime as dt

import shop_fixture as shop
from conftest import rows_of
from shoplens.functions.timeutil import RecentDays, ReportWindow
from shoplens.plans.sync import sync_orders, sync_products
from shoplens.shop import Shop
from shoplens.sources.tables import append_table, read_table

WINDOW = ReportWindow("2020-05-28T00-00-01", "2020-06-28T23-59-59")
KEY = {"client_id": shop.CLIENT, "experiment_id": "exp"}


def test_sync_and_report(spark, table, tmp_path):
    root = str(tmp_path)
    made = "2020-05-27T00:00:00Z"
    append_table(table("clients", [{"client_id": shop.CLIENT, "client_timezone": "Asia/Kolkata"}]), root, "clients")
    append_table(table("experiments", [{**KEY, "creation_time": made, "last_updation_time": made}]), root, "experiments")
    append_table(table("variations", [{**KEY, "variation_id": v, "variation_name": v} for v in "ab"]), root, "variations")
    append_table(table("visits", shop.visit_rows()), root, "visits")
    append_table(table("regions", [{"type": "Feature", "id": "1", "region_name": "North"}]), root, "regions")

    page = shop.order_page()
    page[0]["cart_token"] = None
    page[1]["line_items"][0]["product_id"] = None
    for _ in range(2):
        sync_orders(spark, root, shop.pages(spark, "orders", page), shop.pages(spark, "checkouts", shop.checkout_page()))
        sync_products(spark, root, shop.pages(spark, "products", shop.product_page()))
        counts = {t: read_table(spark, root, t).count() for t in ("orders", "products", "cookies", "events")}
        assert counts == {"orders": 13, "products": 6, "cookies": 1, "events": 1}, "a second run adds nothing"
    assert spark.read.parquet(f"{root}/rejected_orders").select("order_id").distinct().count() == 1
    served = read_table(spark, root, "events").first()
    assert (served.event_name, served.experiment_id) == ("served", "exp")
    assert read_table(spark, root, "cookies").first().session_id == served.session_id

    reports = Shop.stored(spark, root)
    assert rows_of(reports.shop_funnel(WINDOW), "step_id", "visitor_count") == list(enumerate([24, 24, 19, 11, 7, 5], 1))
    assert reports.funnel_churn(WINDOW).first().page == "Product Page"
    assert rows_of(reports.landing_page_conversion(WINDOW), "page_id", "conversion_count") == [(1, 6), (2, 1), (3, 2)]
    assert reports.landing_worst(WINDOW).first().status == "enough"
    assert reports.product_conversion_by_tag(WINDOW).filter("tag = 'sale'").count() == 2
    assert reports.product_worst_by_tag(WINDOW).count() == 3
    sold = reports.conversion_table().filter("order_count > 0").collect()
    assert [(r.variation_id, r.order_count, r.total_order_value) for r in sold] == [(served.variation_id, 1, 34.25)]
    days = RecentDays(dt.datetime(2020, 6, 5, 7, 30))
    assert reports.conversion_over_time(days).filter("sales_conversion_count > 0").count() == 1
    assert reports.conversion_series(days).count() == 2
    assert reports.experiment_summary().first().status == "pending"
    assert reports.sales_by_dimension(WINDOW).isEmpty() and reports.sales_by_region(WINDOW).isEmpty()
