"""The stored orders and products: what a sync writes, what readers see, compaction and failures."""

import os

import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.operators import feeds, merge
from shoplens.plans import variation
from shoplens.sources import folders, tables, versions


def documents(spark, paid=(), still_open=(), client=shop.CLIENT):
    return feeds.order_documents(
        shop.pages(spark, "orders", list(paid), client), shop.pages(spark, "checkouts", list(still_open), client)
    )


def tenants(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "client_id string")


def sizes(root):
    return {str(p): p.stat().st_size for p in root.rglob("*") if p.is_file() and p.suffix == ".parquet"}


def orders(spark, root):
    stored = tables.read_table(spark, root, "orders")
    return rows_of(stored.groupBy("order_id", "payment_status", "updated_at").count().select("order_id", "payment_status", "count"))


def aged(order, day, **more):
    return dict(order, updated_at=f"2020-07-{day:02d}T00:00:00Z", **more)


def many_orders(n, month):
    one = shop.order_page()[0]
    return [dict(one, id=1000 + i, updated_at=f"2020-{month:02d}-{1 + i % 28:02d}T00:00:00Z") for i in range(n)]


def test_a_sync_writes_its_batch_whatever_is_stored(spark, tmp_path):
    written = []
    for n in (50, 5000):
        root = tmp_path / str(n)
        tables.append_table(feeds.order_rows(shop.pages(spark, "orders", many_orders(n, 3))), str(root), "orders")
        before = sizes(root)
        versions.sync_orders(spark, str(root), documents(spark, many_orders(1, 4)))
        after = sizes(root)
        assert before.items() <= after.items(), "stored files stay as they are"
        written.append(sum(after.values()) - sum(before.values()))
        assert tables.read_table(spark, str(root), "orders").filter("order_id = 1000").count() == 2
        assert tables.read_table(spark, str(root), "orders").count() == 2 * n
    assert max(written) < 20_000 and abs(written[0] - written[1]) < 100


def test_no_order_is_seen_open_and_paid(spark, tmp_path):
    root = str(tmp_path)
    checkout = shop.checkout_page()[0]
    versions.sync_orders(spark, root, documents(spark, [], [aged(checkout, 1)]))
    assert orders(spark, root) == [(checkout["id"], False, 2)]
    # One feed may hold both, and a later one the paid order.
    versions.sync_orders(spark, root, documents(spark, [aged(checkout, 1)], [aged(checkout, 1)]))
    assert orders(spark, root) == [(checkout["id"], True, 2)]
    for _ in range(2):
        versions.compact(spark, root, "orders")
        assert orders(spark, root) == [(checkout["id"], True, 2)]


@pytest.mark.parametrize("compacted", [False, True])
def test_later_stored_versions_stay_open_or_paid(spark, tmp_path, compacted):
    root, page = str(tmp_path), shop.order_page()
    checkout = shop.checkout_page()
    versions.sync_orders(spark, root, documents(spark, [aged(page[0], 20)], [aged(checkout[0], 20), aged(checkout[1], 20)]))
    if compacted:
        versions.compact(spark, root, "orders")
    first = orders(spark, root)
    old = [aged(page[0], 10, line_items=[])], [aged(checkout[0], 10)]
    versions.sync_orders(spark, root, documents(spark, *old), tenants(spark, shop.CLIENT))
    kept = [row for row in first if row[0] != checkout[1]["id"]]
    assert orders(spark, root) == kept, "the newer ones stay, the open one that is not named goes"
    # The same in one merge of flat rows.
    stored = feeds.order_batch(shop.pages(spark, "orders", [aged(page[0], 20)]), shop.pages(spark, "checkouts", [aged(c, 20) for c in checkout]))
    pages = shop.pages(spark, "orders", old[0]), shop.pages(spark, "checkouts", old[1])
    merged = merge.upsert_orders(stored, feeds.order_batch(*pages), feeds.named_documents(*pages))
    assert rows_of(merged.groupBy("order_id", "payment_status").count()) == kept


def test_snapshots_close_orders_of_their_tenants_only(spark, tmp_path):
    root, open_ = str(tmp_path), shop.checkout_page()
    versions.sync_orders(spark, root, documents(spark, [], open_).unionByName(documents(spark, [], open_, "other")))
    versions.compact(spark, root, "orders")
    versions.sync_orders(spark, root, documents(spark, [], open_[:1]), tenants(spark, shop.CLIENT))
    left = tables.read_table(spark, root, "orders").select("client_id", "order_id").distinct()
    assert rows_of(left.groupBy("client_id").count()) == [("other", 2), (shop.CLIENT, 1)]
    versions.sync_orders(spark, root, documents(spark), tenants(spark, "other", "unknown"))
    assert rows_of(tables.read_table(spark, root, "orders").select("client_id").distinct()) == [(shop.CLIENT,)]


def test_a_load_counts_once_and_a_broken_one_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    versions.sync_orders(spark, root, documents(spark, shop.order_page()[:2]), load="stream-1")
    before = sizes(tmp_path)
    versions.sync_orders(spark, root, documents(spark, shop.order_page()), load="stream-1")
    assert sizes(tmp_path) == before
    (broken,) = [p for p in (tmp_path / "orders_loads").iterdir() if p.name.startswith("load=")]
    (broken / "_SUCCESS").unlink()
    assert orders(spark, root) == []
    versions.sync_orders(spark, root, documents(spark, shop.order_page()[:2]), load="stream-1")
    assert len(orders(spark, root)) == 2 and (broken / "_SUCCESS").exists(), "written anew"
    assert not versions.append_load(documents(spark), root, "orders", None), "no documents, no load"


def test_a_failed_compaction_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.sync_orders(spark, root, documents(spark, many_orders(30, 3)))
    versions.compact(spark, root, "orders")
    versions.sync_orders(spark, root, documents(spark, [dict(o, line_items=o["line_items"][:1]) for o in many_orders(9, 4)]))
    before = orders(spark, root)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(folders, "mark", fail)
        with pytest.raises(OSError, match="lost"):
            versions.compact(spark, root, "orders")
    assert orders(spark, root) == before
    versions.compact(spark, root, "orders")
    assert orders(spark, root) == before and not versions.state(spark, root, "orders").loads


def test_readers_are_not_disturbed_by_compaction(spark, tmp_path):
    root = str(tmp_path)
    versions.sync_orders(spark, root, documents(spark, many_orders(20, 3)))
    versions.compact(spark, root, "orders")
    versions.sync_orders(spark, root, documents(spark, many_orders(5, 4)))
    running = tables.read_table(spark, root, "orders")
    expected = rows_of(running)
    versions.compact(spark, root, "orders")
    versions.vacuum(spark, root, "orders", keep=1)
    assert rows_of(running) == expected, "what the plan reads is still there"
    assert rows_of(tables.read_table(spark, root, "orders")) == expected
    versions.vacuum(spark, root, "orders", keep=0)
    assert rows_of(tables.read_table(spark, root, "orders")) == expected
    state = versions.state(spark, root, "orders")
    assert not state.dead and len(state.base) == len(folders.matching(spark, f"{root}/orders/*/*/gen=*"))


def test_compaction_rewrites_touched_months_only(spark, tmp_path):
    root = str(tmp_path)
    for month in (1, 2, 3):
        versions.sync_orders(spark, root, documents(spark, [dict(o, id=o["id"] + 100 * month) for o in many_orders(10, month)]))
    versions.compact(spark, root, "orders")
    before = {p for p in sizes(tmp_path / "orders")}
    versions.sync_orders(spark, root, documents(spark, [dict(many_orders(1, 3)[0], id=1205)]))
    versions.compact(spark, root, "orders")
    fresh = {p for p in sizes(tmp_path / "orders")} - before
    assert {p.split("part=")[1].split("/")[0] for p in fresh} == {"2020-02", "2020-03"}, "the order left February for March"
    assert tables.read_table(spark, root, "orders").count() == 60
    # Rows that are appended in bulk join what is there.
    tables.append_table(feeds.order_rows(shop.pages(spark, "orders", [dict(many_orders(1, 2)[0], id=7)])), root, "orders")
    assert tables.read_table(spark, root, "orders").count() == 62
    versions.sync_orders(spark, root, documents(spark, [dict(many_orders(1, 2)[0], id=7, line_items=[])]))
    versions.compact(spark, root, "orders")
    assert tables.read_table(spark, root, "orders").count() == 60


def test_unreadable_documents_change_nothing(spark, tmp_path):
    root, page = str(tmp_path), shop.order_page()
    versions.sync_orders(spark, root, documents(spark, page))
    before = orders(spark, root)
    versions.sync_orders(spark, root, documents(spark, [dict(page[0], updated_at="soon", line_items=[]), dict(page[1], id=None)]))
    assert orders(spark, root) == before


def test_many_loads_are_compacted(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        versions.sync_orders(spark, root, documents(spark, [dict(many_orders(1, 3)[0], id=n)]))
        versions.maintain(spark, root, "orders", loads=3)
    state = versions.state(spark, root, "orders")
    assert len(state.loads) == 2 and len(orders(spark, root)) == 5


def variants(n, price):
    product = shop.product_page()[0]
    item = product["variants"][0]
    return [dict(product, variants=[dict(item, id=i, price=price) for i in range(n)])]


def product_rows(spark, page):
    return feeds.product_rows(shop.pages(spark, "products", page))


def test_unchanged_variants_write_nothing(spark, tmp_path):
    root = str(tmp_path)
    versions.sync_products(spark, root, product_rows(spark, variants(1000, "5.00")))
    versions.compact(spark, root, "products")
    before = sizes(tmp_path)
    versions.sync_products(spark, root, product_rows(spark, variants(1000, "5.00")))
    assert sizes(tmp_path) == before and not versions.state(spark, root, "products").loads
    # One of them changes: the load holds that one, and the stored files stay.
    changed = variants(1000, "5.00")
    changed[0]["variants"][7]["price"] = "6.00"
    versions.sync_products(spark, root, product_rows(spark, changed))
    assert before.items() <= sizes(tmp_path).items()
    (load,) = versions.state(spark, root, "products").loads
    assert [r.variant_id for r in spark.read.parquet(load).collect()] == [7]
    stored = tables.read_table(spark, root, "products")
    assert stored.count() == 1000 and rows_of(stored.filter("variant_price = 6").select("variant_id")) == [(7,)]
    # A null where there was text is a change too.
    blank = [dict(changed[0], tags=None)]
    versions.sync_products(spark, root, product_rows(spark, blank))
    assert tables.read_table(spark, root, "products").filter("tags is null").count() == 1000


def test_product_folders_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "ROWS_PER_FOLDER", 100)
    root = str(tmp_path)
    for n, expected in ((50, {1}), (300, set(range(4, 8))), (310, set(range(4, 8))), (700, set(range(8, 16)))):
        versions.sync_products(spark, root, product_rows(spark, variants(n, "5.00")))
        versions.compact(spark, root, "products")
        versions.vacuum(spark, root, "products", keep=0)
        stored = tables.read_table(spark, root, "products")
        assert stored.count() == n and {r.bucket for r in stored.select("bucket").distinct().collect()} == expected
    versions.sync_products(spark, root, product_rows(spark, variants(700, "5.00")))
    assert not versions.state(spark, root, "products").loads


def test_the_newest_of_several_rows_of_a_variant_counts(spark, tmp_path):
    root, page = str(tmp_path), variants(1, "5.00")
    older, newer = dict(page[0]["variants"][0], updated_at="2020-01-01T00:00:00Z"), dict(page[0]["variants"][0], price="9.00", updated_at="2020-01-02T00:00:00Z")
    versions.sync_products(spark, root, product_rows(spark, [dict(page[0], variants=[newer, older])]))
    assert [str(r.variant_price) for r in tables.read_table(spark, root, "products").collect()] == ["9.00"]


def spoil(paths):
    for path in paths:
        size = os.path.getsize(path)
        with open(path, "wb") as file:
            file.write(b"x" * size)


def test_conversion_reads_no_orders_before_the_first_experiment(spark, tmp_path, table):
    root = str(tmp_path)
    tables.append_table(feeds.order_rows(shop.pages(spark, "orders", many_orders(40, 2) + [dict(o, id=o["id"] + 500) for o in many_orders(40, 6)])), root, "orders")
    key = {"client_id": shop.CLIENT, "experiment_id": "e"}
    experiments = table("experiments", [{**key, "creation_time": "2020-05-20T00:00:00Z"}])
    arms = table("variations", [{**key, "variation_id": "v", "variation_name": "V"}])
    events = table("events", [{**key, "variation_id": "v", "session_id": "s", "event_name": "served", "creation_time": "2020-06-01T00:00:00Z"}])
    cookies = table("cookies", [{"client_id": shop.CLIENT, "session_id": "s", "cart_token": "cart_1", "creation_time": "2020-06-01T00:00:00Z"}])

    def report():
        return variation.conversion_table(arms, experiments, events, tables.read_table(spark, root, "orders"), cookies)

    assert "part" in report()._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    expected = rows_of(report(), "num_visitor", "sales_conversion_count", "order_count", "total_order_value")
    assert expected[0][:3] == (1, 1, 40)
    spoil((tmp_path / "orders").rglob("part=2020-02/**/*.parquet"))
    assert rows_of(report(), "num_visitor", "sales_conversion_count", "order_count", "total_order_value") == expected
    none = table("experiments", [])
    assert rows_of(variation.conversion_table(arms, none, events, tables.read_table(spark, root, "orders"), cookies), "num_visitor", "order_count") == [(1, 0)]


def test_tables_of_users_are_not_taken_for_stored_ones(spark, table):
    from shoplens.functions.timeutil import ReportWindow

    mine = feeds.order_rows(shop.pages(spark, "orders", many_orders(5, 6))).withColumn("open", F.lit(False)).withColumn("part", F.lit("x"))
    window = ReportWindow("2020-05-01T00-00-00", "2020-08-01T00-00-00", "UTC")
    assert window.restrict(mine, "updated_at", table("clients", [])).count() == 10


def test_a_load_is_dealt_out_by_key(spark):
    plan = versions.dealt(documents(spark, many_orders(5, 3)), "orders")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "hashpartitioning(client_id" in plan


@pytest.mark.parametrize("whole", [False, True])
def test_stored_versions_are_looked_up_by_one_join(spark, tmp_path, monkeypatch, whole):
    root, plans = str(tmp_path), []
    tables.append_table(feeds.order_rows(shop.pages(spark, "orders", many_orders(5, 3))), root, "orders")
    monkeypatch.setattr(versions, "append_load", lambda changes, *_: plans.append(changes._jdf.queryExecution().optimizedPlan().toString()))
    versions.sync_orders(spark, root, documents(spark, many_orders(1, 4)), tenants(spark, shop.CLIENT) if whole else None)
    assert plans[0].count("Join ") == 1 + whole, "a second one for the tenants"
