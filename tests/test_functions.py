import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from shoplens.functions import ratio, stats, text
from shoplens.functions import timeutil as tu


def test_percent_rounds_like_python(spark):
    pairs = spark.range(0, 401).withColumnRenamed("id", "d").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("d"))))
    got = pairs.select("n", "d", ratio.percent(F.col("n"), F.col("d")).alias("p")).collect()
    assert len(got) > 80000
    for r in got:
        assert r.p == (round(r.n * 100 / r.d, 2) if r.d else 0.0), r


def test_damped_ratios_round_like_python(spark):
    pairs = spark.range(0, 151).withColumnRenamed("id", "d").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("d") + 3)))
    got = pairs.select(
        "n",
        "d",
        ratio.percent_damped(F.col("n"), F.col("d")).alias("p"),
        ratio.mean_damped((F.col("n") * F.lit(12.34).cast("decimal(8,2)")).cast("decimal(38,2)"), F.col("d")).alias("m"),
    ).collect()
    for r in got:
        assert r.p == min(100.0, round(r.n * 100 / (r.d + 0.01), 2)), r
        assert abs(r.m - round(r.n * 12.34 / (r.d + 0.01), 2)) < 0.011, r


def test_mean_damped_golden(spark):
    df = spark.sql("select cast(3592.00 as decimal(38,2)) t, 2L n")
    assert df.select(ratio.mean_damped(F.col("t"), F.col("n"))).first()[0] == 1787.06


def test_ratios_hold_for_counts_of_a_trillion(spark):
    df = spark.sql("select 333333333333L n, 1000000000000L d")
    assert df.select(ratio.percent(F.col("n"), F.col("d"))).first()[0] == 33.33
    assert df.select(ratio.percent_damped(F.col("n"), F.col("d"))).first()[0] == 33.33


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_times(spark):
    r = one(
        spark,
        iso=tu.iso_utc(tu.epoch_to_time(F.lit(1590046200))),
        bound=F.date_format(tu.report_bound(F.lit("2020-06-20T12-44-47"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss"),
        shown=tu.experiment_date_text(tu.epoch_to_time(F.lit(1590046200))),
        local=tu.local_date_text(F.lit("2020-05-20 20:00:00").cast("timestamp"), "Asia/Kolkata"),
        start=F.date_format(tu.dashboard_date(F.lit("2020-05-21"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss"),
        epoch=tu.iso_to_epoch(F.lit("2020-06-04T14:58:55-04:00")),
        epoch2=tu.iso_to_epoch(F.lit("2020-05-28 19:07:40+05:30")),
        bad=tu.iso_to_epoch(F.lit("soon")),
        hours=tu.elapsed_hours(F.lit("2020-05-01 00:30:00").cast("timestamp"), F.lit("2020-05-03 02:29:59").cast("timestamp")),
    )
    assert r.iso == "2020-05-21T07:30:00+00:00"
    assert r.bound == "2020-06-20 07:14:47"
    assert r.shown == "21-May-2020"
    assert r.local == "2020-05-21"
    assert r.start == "2020-05-20 18:30:00"
    assert r.epoch == 1591297135 and r.epoch2 == 1590673060
    assert r.bad is None
    assert r.hours == 49


def test_day_grid(spark, table):
    clients = table("clients", [{"client_id": "a", "client_timezone": "Asia/Kolkata"}])
    days = tu.RecentDays(dt.datetime(2020, 5, 21, 7, 30))
    got = days.grid(clients).orderBy("day").select(tu.iso_utc(F.col("start_time")), tu.iso_utc(F.col("end_time")), "label")
    expected = [
        (f"2020-05-{14 + i}T18:30:00+00:00", f"2020-05-{15 + i}T18:29:59+00:00", f"May {15 + i}") for i in range(6)
    ] + [("2020-05-20T18:30:00+00:00", "2020-05-21T07:30:00+00:00", "May 21")]
    assert [tuple(r) for r in got.collect()] == expected


def test_recent_days_edges(spark, table):
    clients = table("clients", [{"client_id": "a", "client_timezone": "America/New_York"}])
    # 2024-03-10 lost an hour in New York: local midnight moves from 05:00Z to 04:00Z.
    times = [
        "2024-03-09T04:59:59Z",
        "2024-03-09T05:00:00Z",
        "2024-03-09T05:00:01Z",
        "2024-03-10T04:59:59Z",
        "2024-03-11T03:59:58Z",
        "2024-03-11T03:59:59Z",
        "2024-03-11T04:00:00Z",
        "2024-03-11T12:00:00Z",
    ]
    visits = table("visits", [{"client_id": "a", "session_id": t, "creation_time": t} for t in times])

    def days(**kw):
        spec = tu.RecentDays(dt.datetime(2024, 3, 11, 12, 0), days=3, **kw)
        return {r.session_id: str(r.day) for r in spec.bucket(visits, "creation_time", clients).collect()}

    assert days() == {
        "2024-03-09T05:00:00Z": "2024-03-09",
        "2024-03-09T05:00:01Z": "2024-03-09",
        "2024-03-10T04:59:59Z": "2024-03-09",
        "2024-03-11T03:59:58Z": "2024-03-10",
        "2024-03-11T03:59:59Z": "2024-03-10",
        "2024-03-11T04:00:00Z": "2024-03-11",
    }
    assert set(days(strict_edges=True)) == {"2024-03-09T05:00:01Z", "2024-03-11T03:59:58Z"}


def test_report_window_is_open_and_local(spark, table):
    clients = table(
        "clients",
        [{"client_id": "a", "client_timezone": "Asia/Kolkata"}, {"client_id": "b", "client_timezone": "UTC"}],
    )
    times = ["2024-01-01T18:30:00Z", "2024-01-01T18:30:01Z", "2024-01-02T00:00:00Z", "2024-01-02T00:00:01Z", "2024-01-02T18:30:00Z"]
    visits = table(
        "visits",
        [{"client_id": c, "session_id": t, "creation_time": t} for c in "abx" for t in times],
    )
    window = tu.ReportWindow("2024-01-02T00-00-00", "2024-01-03T00-00-00")
    got = rows_of(window.restrict(visits, "creation_time", clients), "client_id", "session_id")
    assert got == [
        ("a", times[1]), ("a", times[2]), ("a", times[3]), ("b", times[3]), ("b", times[4]),
    ]
    fixed = tu.ReportWindow("2024-01-02T00-00-00", "2024-01-03T00-00-00", "Asia/Kolkata")
    assert rows_of(fixed.restrict(visits, "creation_time", clients), "client_id", "session_id") == [
        (c, t) for c in "abx" for t in times[1:4]
    ]


def test_text_rules(spark):
    df = spark.createDataFrame(
        [("/products/x ", "a, b,a", "/collections/products"), ("x?y=1", "", "/collections/all"), ("/", None, None), ("", " a", "/checkout")],
        "url string, tags string, landing string",
    )
    got = df.select(text.last_path_segment(F.col("url")), text.tag_list(F.col("tags")), text.page_type(F.col("landing"))).collect()
    assert [tuple(r) for r in got] == [
        ("x", ["a", "b"], "product"),
        ("x?y=1", ["no-tag"], "collection"),
        ("", ["no-tag"], "home"),
        ("", ["a"], "product"),
    ]


@pytest.mark.parametrize("arms,size", [(2, 1569), (3, 1926), (4, 2180), (5, 2387), (6, 2565), (7, 2724), (8, 2870), (9, 3004), (10, 3129)])
def test_sample_size(arms, size):
    assert stats.sample_size_for_arms(arms) == size


def test_chi_square(spark):
    df = spark.createDataFrame(
        [(30, 100, 20, 100), (5, 10, 5, 10), (0, 10, 0, 10), (1, 0, 1, 5), (10, 10, 10, 10)], "c1 long, n1 long, c2 long, n2 long"
    )
    x = stats.pooled_chi_square(*[F.col(c) for c in df.columns])
    got = df.select(x.alias("x")).withColumn("c", stats.chi_square_confidence("x")).collect()
    assert got[0].x == pytest.approx(2.6666667) and got[0].c == pytest.approx(1 - 0.1024704, abs=1e-6)
    assert got[1].x == 0.0 and got[1].c == 0.0
    assert [r.c for r in got[2:]] == [None, None, None]
