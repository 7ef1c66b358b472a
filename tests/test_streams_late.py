"""Late rows, incremental visitors, packed days and anonymous carts, over several micro-batches and replays."""

import collections
import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.operators import experiments
from shoplens.plans import sync
from shoplens.schemas import FEED_PAGES, ddl
from shoplens.sources import folders, tables
from shoplens.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(minutes, session, name="served", arm="x"):
    when = (T0 + dt.timedelta(minutes=minutes)).isoformat()
    return {"client_id": "a", "experiment_id": "e", "variation_id": arm, "session_id": session, "event_name": name, "creation_time": when}


@pytest.fixture()
def delivered(spark, table, tmp_path):
    """Runs a stream job once per delivery; ``again`` runs the last micro-batch a second time."""

    class Delivered:
        root, progress, landing = (str(tmp_path / name) for name in ("store", "progress", "landing"))

        def run(self, job, rows, *more):
            if rows:
                table("events", rows).coalesce(1).write.mode("append").parquet(self.landing)
            job(spark.readStream.schema(ddl("events")).parquet(self.landing), self.root, *more, self.progress).awaitTermination()

        def again(self, job, *more):
            commits = sorted((pathlib.Path(self.progress) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            commits[-1].unlink()
            (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
            self.run(job, [], *more)

        def stored(self):
            return spark.read.schema(ddl("events")).parquet(self.landing)

    return Delivered()


DAY = 24 * 60
DELIVERIES = [
    [event(10, "s1"), event(2 * DAY, "s2"), event(2 * DAY + 5, None)],
    # The first day ended a day before the last time seen: late. The second day did not.
    [event(20, "s3"), event(20, "s1", "clicked"), event(DAY + 1, "s1"), event(6 * DAY, "s1"), event(6 * DAY, "s1")],
    [event(DAY + 2, "s9"), event(4 * DAY, "s9"), event(5 * DAY, "s9"), event(6 * DAY + 1, "s1"), event(30, None)],
]


def plain_late(deliveries, delay):
    late, mark = [], None
    for number, rows in enumerate(deliveries):
        times = [dt.datetime.fromisoformat(r["creation_time"]) for r in rows]
        for row, time in zip(rows, times, strict=True):
            end = time.replace(hour=0, minute=0) + dt.timedelta(days=1)
            if mark is not None and end <= mark - delay:
                late.append((number, row["session_id"], time.day))
        mark = max([*times, *([mark] if mark else [])])
    return sorted(late, key=str)


def test_late_rows_have_a_table_and_restate_their_days(spark, delivered):
    for rows in DELIVERIES:
        delivered.run(jobs.late_row_stream, rows)
    for _ in range(2):
        found = jobs.read_late_rows(spark, delivered.root).withColumn("d", F.dayofmonth("creation_time"))
        got = sorted([(r.batch_id, r.session_id, r.d) for r in found.collect()], key=str)
        assert got == plain_late(DELIVERIES, dt.timedelta(days=1)) and len(got) >= 5
        counts = jobs.read_restated_counts(spark, delivered.root)
        every = delivered.stored().groupBy(F.to_date("creation_time").alias("day"), "event_name").count()
        assert rows_of(counts.groupBy("day", "event_name").agg(F.sum("restated").alias("n"))) == rows_of(every)
        assert counts.agg(F.sum("late_events")).first()[0] == len(got)
        delivered.again(jobs.late_row_stream)


def test_visitors_are_exact_and_no_event_is_read_again(spark, delivered):
    for rows in DELIVERIES:
        delivered.run(jobs.daily_visitor_stream, rows)
    expected = experiments.event_counts(delivered.stored().withColumn("day", F.to_date("creation_time")), "day").drop("served_rows")
    for _ in range(2):
        assert rows_of(jobs.read_daily_visitors(spark, delivered.root), *expected.columns) == rows_of(expected)
        delivered.again(jobs.daily_visitor_stream)
    kept = {p.name for p in pathlib.Path(delivered.root).iterdir()}
    assert kept == {"seen_sessions", "visitor_counts"}, "sessions and counts, no events"
    seen = spark.read.parquet(f"{delivered.root}/seen_sessions")
    per_session = collections.Counter((r.day, r.variation_id, r.session_id) for r in seen.collect())
    assert max(per_session.values()) <= 2, "a session is stored when first served and when first clicked"


def folders_of(root, table):
    return collections.Counter(p.parent.name for p in (pathlib.Path(root) / table).glob("day=*/load=*"))


def test_closed_days_are_packed(spark, delivered, monkeypatch):
    def append(rows, root, progress):
        return jobs.append_stream(rows, root, "events", progress)

    root = delivered.root
    for n in range(4):
        delivered.run(append, [event(m * 7 + n * DAY // 4, f"s{m}") for m in range(3)] + [event(3 * DAY + n, "late")])
    read = lambda: rows_of(tables.read_table(spark, root, "events").drop("load"))
    before, running = read(), tables.read_table(spark, root, "events")
    assert folders_of(root, "events") == {"day=2024-01-01": 4, "day=2024-01-04": 4}

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(spark.__class__, "createDataFrame", fail)
        with pytest.raises(OSError, match="lost"):
            tables.pack_days(spark, root, "events", dt.date(2024, 1, 3))
    assert read() == before, "rows written by a failed run are not read"
    assert tables.pack_days(spark, root, "events", dt.date(2024, 1, 3)) == 4
    assert read() == before and rows_of(running.drop("load")) == before
    assert tables.pack_days(spark, root, "events", dt.date(2024, 1, 3)) == 0, "nothing left to pack"
    tables.drop_packed(spark, root, "events")
    assert read() == before
    # The last load comes once more, and late rows arrive on the packed day; both are right, and pack again.
    delivered.again(append)
    assert read() == before
    delivered.run(append, [event(1, "later")])
    assert len(read()) == len(before) + 1
    assert tables.pack_days(spark, root, "events", dt.date(2024, 1, 3)) == 2
    tables.drop_packed(spark, root, "events")
    assert len(read()) == len(before) + 1
    files = list((pathlib.Path(root) / "events" / "day=2024-01-01").rglob("load=packed*/*.parquet"))
    assert 1 <= len(files) <= 3, "few files, however many loads there were"
    tables.append_table(tables.read_table(spark, root, "events").limit(5), root, "events")
    assert len(read()) == len(before) + 6
    assert tables.pack_days(spark, root, "visits", dt.date(2024, 1, 3)) == 0


def test_anonymous_carts_of_a_stream_equal_those_of_a_batch(spark, table, tmp_path):
    landing, roots = tmp_path / "pages", {kind: str(tmp_path / kind) for kind in ("stream", "batch")}
    landing.mkdir()
    page = shop.order_page()
    page[0]["cart_token"], page[1]["cart_token"], page[2]["cart_token"] = None, "", None
    key = {"client_id": shop.CLIENT, "experiment_id": "e"}
    for root in roots.values():
        tables.append_table(table("experiments", [{**key, "last_updation_time": "2020-06-02T00:00:00Z"}]), root, "experiments")
        tables.append_table(table("variations", [{**key, "variation_id": v} for v in "xy"]), root, "variations")
    # An order may come again with a later time: its cookie and event are there already.
    again = dict(page[0], updated_at="2020-07-01T00:00:00Z")
    for name, own in (("1", page[:2]), ("2", [page[2], again])):
        (landing / f"{name}.json").write_text(json.dumps({"client_id": shop.CLIENT, "orders": own}) + "\n")
        schema = f"client_id string, {FEED_PAGES['orders']}, {FEED_PAGES['checkouts']}"
        stream = spark.readStream.schema(schema).json(str(landing))
        jobs.order_sync_stream(stream, roots["stream"], str(tmp_path / "progress")).awaitTermination()
        sync.sync_orders(spark, roots["batch"], shop.pages(spark, "orders", own), shop.pages(spark, "checkouts", []))
    for _ in range(2):
        for name, n in (("cookies", 3), ("events", 3), ("orders", 6)):
            got = [rows_of(tables.read_table(spark, root, name).drop("load", "day")) for root in roots.values()]
            assert got[0] == got[1] and len(got[0]) == n, name
        # The last micro-batch once more.
        commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        jobs.order_sync_stream(stream, roots["stream"], str(tmp_path / "progress")).awaitTermination()


def test_a_missing_pattern_has_no_folders(spark, tmp_path):
    assert folders.matching(spark, f"{tmp_path}/none/*/x=*") == []
