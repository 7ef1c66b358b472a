import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.functions.timeutil import ReportWindow
from shoplens.operators import dims, feeds, merge
from shoplens.sources import documents, tables


def lines(df):
    return rows_of(df, "client_id", "order_id", "variant_id", "payment_status")


def batch_of(spark, paid, still_open, client=shop.CLIENT):
    return feeds.order_batch(
        shop.pages(spark, "orders", paid, client), shop.pages(spark, "checkouts", still_open, client)
    )


def test_order_feed(spark):
    rows = batch_of(spark, shop.order_page(), shop.checkout_page())
    assert rows.count() == 14
    first = rows.filter("order_id = 1 and variant_id = 11").first()
    assert (first.email_id, first.cart_token, first.variant_quantity, str(first.variant_price)) == ("ann", "cart_1", 1, "12.50")
    assert first.payment_status and first.landing_page == "/"
    assert rows.filter("order_id = 1").select(F.unix_timestamp("updated_at")).first()[0] == int((shop.OPENED + dt.timedelta(days=2)).timestamp())
    assert rows.filter("not payment_status").count() == 4


def test_empty_feed(spark):
    assert batch_of(spark, [], []).isEmpty()


def test_anonymous_orders_get_a_stable_identity(spark):
    page = shop.order_page()
    page[0]["cart_token"], page[1]["cart_token"] = None, ""
    docs = shop.pages(spark, "orders", page)
    rows, again = feeds.order_rows(docs), feeds.order_rows(docs)
    tokens = {r.order_id: r.cart_token for r in rows.collect()}
    assert tokens == {r.order_id: r.cart_token for r in again.collect()}
    assert len(tokens[1]) == 32 and len(tokens[2]) == 32 and tokens[1] != tokens[2]
    assert tokens[3] == "cart_3"
    carts = feeds.anonymous_carts(docs)
    assert sorted(r.cart_token for r in carts.collect()) == sorted([tokens[1], tokens[2]])
    assert carts.select("session_id").distinct().count() == 2
    # An open checkout without a cart stays without one.
    still_open = shop.checkout_page()
    still_open[0]["cart_token"] = None
    assert feeds.checkout_rows(shop.pages(spark, "checkouts", still_open)).filter("cart_token is null").count() == 2


def test_bad_rows_are_set_aside(spark):
    page = shop.order_page()
    page[0]["line_items"][0]["product_id"] = None
    page[1]["updated_at"] = "yesterday"
    page[2]["line_items"][0]["quantity"] = "many"
    page[2]["line_items"][1]["price"] = "free"
    rows = feeds.order_rows(shop.pages(spark, "orders", page))
    good = feeds.complete(rows, feeds.ORDER_REQUIRED)
    bad = feeds.rejected(rows, feeds.ORDER_REQUIRED)
    assert good.count() == 5
    assert rows_of(bad.withColumn("missing", F.concat_ws(",", "missing")), "order_id", "missing") == [
        (1, "product_id"), (2, "updated_at"), (2, "updated_at"), (3, "variant_price"), (3, "variant_quantity"),
    ]


def test_unreadable_pages_keep_their_text(spark, tmp_path):
    texts = spark.createDataFrame([("a", "{oops"), ("b", json.dumps({"orders": shop.order_page()}))], "client_id string, body string")
    pages = documents.parse_pages(texts, "orders")
    assert feeds.order_rows(pages).select("client_id").distinct().collect() == [("b",)]
    assert rows_of(documents.unreadable_pages(pages)) == [("a", "{oops")]
    (tmp_path / "page.json").write_text('{"client_id": "c", "orders": []}\n{oops\n')
    landed = documents.read_feed(spark, str(tmp_path / "page.json"), "orders")
    assert [r.unreadable for r in documents.unreadable_pages(landed).collect()] == ["{oops"]
    none = spark.createDataFrame([("a", None)], "client_id string, orders array<string>")
    assert documents.unreadable_pages(none).isEmpty()


def test_rejects_are_kept_once(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for _ in range(2):
        tables.keep_load(rows, f"{root}/rejected")
    tables.keep_load(rows.filter("a = 1"), f"{root}/rejected", "other")
    tables.keep_load(rows.filter("a = 9"), f"{root}/rejected", "none")
    assert rows_of(spark.read.parquet(f"{root}/rejected"), "a") == [(1,), (1,), (2,)]


def test_other_loads_of_equal_rows_are_kept_too(spark, tmp_path):
    path, schema = f"{tmp_path}/rejected", "a int, b string, c string"
    loads = [[(1, "x", "y")] * 2, [(2, "x", "y")] * 2, [(1, "x", "y")] * 2, [(3, None, "z")], [(3, "z", None)]]
    for load in loads:
        tables.keep_load(spark.createDataFrame(load, schema), path)
    kept = rows_of(spark.read.parquet(path), "a", "b", "c")
    assert kept == [(1, "x", "y")] * 2 + [(2, "x", "y")] * 2 + [(3, None, "z"), (3, "z", None)]


def test_an_order_without_lines_goes(spark, tmp_path):
    root = str(tmp_path)
    tables.merge_orders(spark, root, batch_of(spark, shop.order_page(), []))
    emptied, bare = dict(shop.order_page()[0], line_items=[]), shop.pages(spark, "checkouts", [])
    orders = shop.pages(spark, "orders", [emptied, shop.order_page()[2]])
    named = feeds.named_documents(orders, bare)
    assert rows_of(named, "order_id") == [(None,), (1,), (3,)]
    tables.merge_orders(spark, root, feeds.order_batch(orders, bare), named)
    stored = tables.read_table(spark, root, "orders")
    assert rows_of(stored.select("order_id").distinct()) == [(2,), (3,), (4,), (5,)]


def test_a_later_stored_version_stays(spark):
    stored = batch_of(spark, shop.order_page()[:1], [])
    old = dict(shop.order_page()[0], updated_at="2019-01-01T00:00:00Z", line_items=shop.order_page()[0]["line_items"][:1])
    assert merge.upsert_orders(stored, batch_of(spark, [old], [])).exceptAll(stored).isEmpty()


def test_report_windows_prune_stored_orders(spark, tmp_path, table):
    root = str(tmp_path)
    rows = [dict(o, id=10**13 * (i + 1) + i) for i, o in enumerate(shop.order_page())]
    tables.merge_orders(spark, root, batch_of(spark, rows, shop.checkout_page()))
    assert len([p for p in (tmp_path / "orders").rglob("part=*")]) == 2, "few folders, however large the ids"
    stored = tables.read_table(spark, root, "orders")
    clients = table("clients", [{"client_id": shop.CLIENT, "client_timezone": "UTC"}])
    near = ReportWindow("2020-06-01T00-00-00", "2020-06-30T00-00-00").restrict(stored, "updated_at", clients)
    assert near.count() == 14
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_products_feed(spark):
    rows = feeds.product_rows(shop.pages(spark, "products", shop.product_page()))
    assert rows_of(rows, "product_id", "variant_id", "tags")[0] == (1, 11, "wool, sale")
    assert rows.count() == 6


def test_landed_files(spark, tmp_path):
    for client in ("a", "b"):
        folder = tmp_path / f"client_id={client}"
        folder.mkdir()
        (folder / "page1.json").write_text(json.dumps({"orders": shop.order_page()}, indent=2))
    pages = documents.read_feed(spark, str(tmp_path), "orders", multi_line=True)
    assert rows_of(feeds.order_rows(pages).groupBy("client_id").count()) == [("a", 10), ("b", 10)]
    names = documents.list_files(spark, str(tmp_path), prefix="page")
    assert [r.name for r in names.collect()] == ["page1.json"] * 2
    assert documents.list_files(spark, str(tmp_path), max_count=1).count() == 1
    assert documents.list_files(spark, str(tmp_path), prefix="zzz").count() == 0


def test_json_roundtrip(spark, tmp_path):
    pages = shop.pages(spark, "orders", shop.order_page())
    documents.write_json(pages, str(tmp_path / "docs"))
    back = documents.read_feed(spark, str(tmp_path / "docs"), "orders")
    assert feeds.order_rows(back).exceptAll(feeds.order_rows(pages)).isEmpty()
    (tmp_path / "regions.json").write_text(json.dumps([{"type": "Feature", "id": "01", "region_name": "Alabama", "geometry": {"type": "Polygon", "coordinates": [[[1, 2]]]}}]))
    region = documents.read_regions(spark, str(tmp_path / "regions.json")).first()
    assert region.id == "01" and json.loads(region.geometry)["coordinates"] == [[[1, 2]]]


def test_watermarks_and_incremental_filter(spark, table):
    page = shop.order_page()
    for i, o in enumerate(page):
        o["updated_at"] = f"2020-06-04T10:00:0{i}+00:00"
    rows = feeds.order_rows(shop.pages(spark, "orders", page))
    stored = rows.filter("order_id <= 2").unionByName(feeds.checkout_rows(shop.pages(spark, "checkouts", shop.checkout_page())))
    mark = feeds.order_watermark(stored)
    assert mark.select(F.date_format("watermark", "HH:mm:ss")).first()[0] == "10:00:02"
    assert {r.order_id for r in feeds.since(rows, mark).collect()} == {3, 4, 5}
    other = rows.withColumn("client_id", F.lit("new"))
    assert feeds.since(other, mark).count() == 10


def test_order_upsert_rules(spark):
    stored = batch_of(spark, shop.order_page(), shop.checkout_page()).unionByName(
        batch_of(spark, shop.order_page()[:1], shop.checkout_page()[:1], "other")
    )
    newer = shop.order_page()[:1]
    newer[0]["line_items"] = newer[0]["line_items"][:1]
    got = merge.upsert_orders(stored, batch_of(spark, newer, []))
    mine = got.filter(F.col("client_id") == shop.CLIENT)
    assert mine.filter("not payment_status").isEmpty()
    assert mine.filter("order_id = 1").count() == 1 and mine.count() == 9
    assert got.filter("client_id = 'other'").count() == 4
    assert merge.upsert_orders(stored, batch_of(spark, [], [])).count() == stored.count()


def test_stored_orders_merge(spark, tmp_path):
    root = str(tmp_path)

    def sync(paid, still_open, client=shop.CLIENT):
        tables.merge_orders(spark, root, batch_of(spark, paid, still_open, client))
        return tables.read_table(spark, root, "orders")

    far = shop.order_page()[4:]
    far[0]["id"] = 3 * 10**13
    assert sync(shop.order_page(), shop.checkout_page()).count() == 14
    assert sync(shop.order_page(), shop.checkout_page()).count() == 14, "a repeated sync changes nothing"
    assert sync(far, shop.checkout_page()).count() == 16
    assert sync([], shop.checkout_page()[:1], "other").filter("client_id = 'other'").count() == 2
    # All checkouts of the first client are gone: its open folder rows go, the other's stay.
    after = sync(shop.order_page()[:1], [])
    assert rows_of(after.groupBy("client_id", "payment_status").count()) == [("other", False, 2), (shop.CLIENT, True, 12)]
    last = sync(shop.order_page()[:1], [], "other")
    assert last.filter("not payment_status").isEmpty() and last.count() == 14
    assert not [p for p in (tmp_path / "orders").rglob("open=true/*/*.parquet")]


def test_merge_reads_only_touched_folders(spark, tmp_path):
    root = str(tmp_path)
    old = [dict(o, updated_at=f"2020-0{i + 1}-03T00:00:00Z") for i, o in enumerate(shop.order_page())]
    tables.merge_orders(spark, root, batch_of(spark, old, []))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "orders").rglob("*.parquet")}
    before = files()
    assert len(before) == 5
    tables.merge_orders(spark, root, batch_of(spark, old[:1], []))
    after = files()
    assert len(set(before.items()) & set(after.items())) == 4 and len(after) == 5
    # An update moves the order to the month of its new version.
    tables.merge_orders(spark, root, batch_of(spark, [dict(old[0], updated_at="2020-05-09T00:00:00Z")], []))
    assert len(set(after.items()) & set(files().items())) == 3 and len(files()) == 4
    assert tables.read_table(spark, root, "orders").count() == 10


def test_stored_products_merge(spark, tmp_path):
    root = str(tmp_path)
    full = feeds.product_rows(shop.pages(spark, "products", shop.product_page()))
    for _ in range(2):
        tables.merge_products(spark, root, full)
        assert tables.read_table(spark, root, "products").count() == 6
    one = shop.product_page()[:1]
    one[0]["variants"] = one[0]["variants"][:1]
    one[0]["variants"][0]["price"] = "55.00"
    tables.merge_products(spark, root, feeds.product_rows(shop.pages(spark, "products", one)))
    stored = tables.read_table(spark, root, "products")
    assert stored.count() == 6
    assert str(stored.filter("variant_id = 11").first().variant_price) == "55.00"


def test_append_keeps_duplicates_and_lays_out_by_day(spark, tmp_path):
    raw = spark.createDataFrame(
        [("a", "s1", "phone", 1590673060), ("a", "s1", "phone", 1590673060), ("a", "s2", "desk", 1590773060)],
        "client_id string, session_id string, device string, creation_time bigint",
    )
    root = str(tmp_path)
    tables.append_table(dims.append_rows(raw, "visitors"), root, "visitors")
    stored = tables.read_table(spark, root, "visitors")
    assert stored.count() == 3
    assert {p.name for p in (tmp_path / "visitors").iterdir() if p.is_dir()} == {"day=2020-05-28", "day=2020-05-29"}
    assert tables.read_table(spark, root, "visits").isEmpty()


def test_cookies_first_write_wins(table):
    def cookie(session, cart, when):
        return {"client_id": "a", "session_id": session, "cart_token": cart, "creation_time": f"2020-01-01T00:00:0{when}Z"}

    stored = table("cookies", [cookie("s1", "c1", 0)])
    incoming = table(
        "cookies",
        [cookie("s1", "c1", 5), cookie("s1", "c2", 4), cookie("s1", "c2", 3), cookie("", "c3", 1), cookie("s2", "", 1), cookie(None, "c4", 1)],
    )
    got = merge.new_cookies(stored, incoming).withColumn("t", F.second("creation_time"))
    assert rows_of(got, "session_id", "cart_token", "t") == [("s1", "c2", 3)]


@pytest.fixture()
def experiment(table):
    return (
        table("experiments", [{"client_id": "a", "experiment_id": e, "last_updation_time": t} for e, t in [("old", "2020-01-01T00:00:00Z"), ("new", "2020-02-01T00:00:00Z")]]),
        table("variations", [{"client_id": "a", "experiment_id": e, "variation_id": v, "variation_name": v} for e in ("old", "new") for v in "xy"]),
        table("events", [{"client_id": "a", "experiment_id": "new", "variation_id": "y", "session_id": "s1", "event_name": "clicked", "creation_time": "2020-03-01T00:00:00Z"}]),
    )


def test_events_only_for_sessions_without_any(table, experiment):
    _, _, events = experiment

    def served(session, variation, when):
        return {"client_id": "a", "experiment_id": "new", "variation_id": variation, "session_id": session, "event_name": "served", "creation_time": when}

    incoming = table("events", [served("s1", "x", "2020-03-02T00:00:00Z"), served("s2", "y", "2020-03-03T00:00:00Z"), served("s2", "x", "2020-03-02T00:00:00Z")])
    assert rows_of(merge.new_events(events, incoming), "session_id", "variation_id", "event_name") == [("s2", "x", "served")]


def test_cookie_registration_serves_the_latest_experiment(table, experiment):
    experiments, variations, events = experiment
    cookies = table("cookies", [{"client_id": "a", "session_id": s, "cart_token": "c", "creation_time": "2020-03-05T00:00:00Z"} for s in ("s1", "s2", "s2")])
    got = merge.cookie_events(cookies, experiments, events, variations)
    assert rows_of(got, "experiment_id", "session_id", "event_name") == [("new", "s2", "served")]
    # The backfill of anonymous carts logs an event even where the session has one.
    sessions = cookies.select("client_id", "session_id", "creation_time").distinct()
    back = merge.serve_latest(sessions, experiments, events, variations)
    assert rows_of(back.filter("session_id = 's1'"), "variation_id", "event_name") == [("y", "served")]
    assert back.count() == 2


def test_new_dimension_rows(spark):
    raw = spark.createDataFrame(
        [("a", "exp", "home", "split", "active", 1590573060, 1590573060)],
        "client_id string, experiment_name string, page_type string, experiment_type string, status string, creation_time bigint, last_updation_time bigint",
    )
    first, again = dims.new_experiments(raw).first(), dims.new_experiments(raw).first()
    assert first == again and len(first.experiment_id) == 32
    arms = spark.createDataFrame([("a", "e", "x", 50), ("a", "e", "y", 50)], "client_id string, experiment_id string, variation_name string, traffic_percentage int")
    assert dims.new_variations(arms).select("variation_id").distinct().count() == 2
    client = spark.createDataFrame([("a", "Ann", "Co", False, "u", "UTC", 1590673060, "secret")], "client_id string, full_name string, company_name string, disabled boolean, shopify_app_eg_url string, client_timezone string, creation_timestamp bigint, hashed_password string")
    row = dims.new_clients(client).first()
    assert row.full_name == "Ann" and "hashed_password" not in row.asDict()


def test_an_upsert_meets_each_table_once(spark):
    stored = batch_of(spark, shop.order_page(), shop.checkout_page())
    got = merge.upsert_orders(stored, batch_of(spark, shop.order_page()[:1], []))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 7, "18 joins before: each named and stored order now meets one"


def test_upsert_of_null_keys_and_states(spark, table):
    def row(client, order, when, paid):
        return {"client_id": client, "order_id": order, "variant_id": 1, "updated_at": f"2020-03-0{when}T00:00:00Z", "payment_status": paid}

    stored = table("orders", [row("a", 1, 1, None), row("a", 2, 5, False), row("a", 2, 1, False), row("a", 3, 1, False), row("a", None, 1, True), row(None, 4, 1, False)])
    batch = table("orders", [row("a", 2, 3, True), row("a", 9, 3, True), row("a", None, 3, True), row(None, 4, 3, True)])
    got = rows_of(merge.upsert_orders(stored, batch), "client_id", "order_id", "payment_status")
    kept = [("a", 1, None), ("a", 2, False), ("a", 2, False), ("a", None, True), (None, 4, False)]
    assert got == sorted([*kept, ("a", 9, True), ("a", None, True), (None, 4, True)], key=lambda t: tuple((v is not None, str(v)) for v in t))
