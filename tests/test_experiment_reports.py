import datetime as dt
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import shop_fixture as shop
from conftest import rows_of
from shoplens.functions.timeutil import RecentDays
from shoplens.operators import experiments as ops
from shoplens.operators import feeds, lookups, sales
from shoplens.plans import summary, variation

BASE = dt.datetime(2021, 3, 9, 14, 12, 5, tzinfo=dt.timezone.utc)
DAYS = RecentDays(dt.datetime(2021, 3, 11, 8, 10), timezone="Asia/Kolkata")
KEY = {"client_id": shop.CLIENT, "experiment_id": "exp"}


def at(seconds=0):
    return (BASE + dt.timedelta(seconds=seconds)).isoformat()


def event(session, arm, name, seconds=0, **kw):
    return {**KEY, "session_id": session, "variation_id": arm, "event_name": name, "creation_time": at(seconds), **kw}


# Arm a: three sessions served, one of them twice, two clicked. Arm b: two served, one clicked twice.
EVENTS = [
    *[event(f"p{i}", "a", "served", 60 * i) for i in (1, 2, 3, 3)],
    *[event(f"q{i}", "b", "served", 600 + 60 * i) for i in (1, 2)],
    *[event(s, v, "clicked", 900 + n) for n, (s, v) in enumerate([("p2", "a"), ("q1", "b"), ("q1", "b"), ("p3", "a")])],
]
# p1 bought carts 1 and 2, q2 looked at cart 2 as well; nobody who was served owns cart 22.
CARTS = [("p1", "cart_1"), ("p1", "cart_2"), ("q2", "cart_2"), ("q1", "cart_21"), ("nobody", "cart_22")]
COOKIES = [{"client_id": shop.CLIENT, "session_id": s, "cart_token": c, "creation_time": at()} for s, c in CARTS]


@pytest.fixture()
def lab(spark, table):
    """Two variations, two paid orders of two lines and two open checkouts."""
    paid = [dict(o, updated_at=at(3600)) for o in shop.order_page()[:2]]
    still_open = shop.checkout_page()
    return {
        "clients": table("clients", [{"client_id": shop.CLIENT, "client_timezone": "UTC"}]),
        "experiments": table("experiments", [{**KEY, "creation_time": "2021-03-08T10:00:00Z", "last_updation_time": "2021-03-08T10:00:00Z"}]),
        "variations": table("variations", [{**KEY, "variation_id": v, "variation_name": f"name_{v}", "traffic_percentage": 50} for v in "ab"]),
        "events": table("events", EVENTS),
        "cookies": table("cookies", COOKIES),
        "orders": feeds.order_batch(shop.pages(spark, "orders", paid), shop.pages(spark, "checkouts", still_open)),
    }


def damped(total, count):
    return round(total / (count + 0.01), 2)


def table_of(lab):
    df = variation.conversion_table(lab["variations"], lab["experiments"], lab["events"], lab["orders"], lab["cookies"])
    return {r.variation_id: tuple(r)[4:] for r in df.collect()}


def test_conversion_table(lab, table):
    assert table_of(lab) == {
        # Order 1 is worth 34.25, order 2 is 102; rates are over 0.01 more than the count.
        "a": (4, 3, 2, 1, 2, 136.25, damped(200, 3), damped(100, 3), damped(136.25, 2)),
        "b": (2, 2, 1, 1, 1, 102.0, damped(100, 2), damped(100, 2), damped(102, 1)),
    }
    lab["events"] = table("events", [])
    assert set(table_of(lab).values()) == {(0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)}


def test_unknown_experiment_has_no_sales(lab, table):
    lab["experiments"] = table("experiments", [])
    assert table_of(lab) == {
        "a": (4, 3, 2, 0, 0, 0.0, damped(200, 3), 0.0, 0.0),
        "b": (2, 2, 1, 0, 0, 0.0, damped(100, 2), 0.0, 0.0),
    }


def test_clicks_of_an_unserved_variation_are_left_out(table):
    rows = [event("s1", "a", "clicked"), event(None, "b", "served"), event("s2", "b", "clicked")]
    assert rows_of(ops.variation_event_counts(table("events", rows)), "variation_id", "num_session", "num_visitor", "goal_conversion_count") == [
        ("b", 0, 0, 1)
    ]


def test_conversion_over_time(lab, table):
    def series(events):
        df = variation.conversion_over_time(lab["variations"], lab["clients"], events, lab["orders"], lab["cookies"], DAYS)
        return {r.variation_id: r for r in variation.conversion_series(df).collect()}

    got = series(lab["events"])
    fifth = lambda v, zero=0: [zero] * 4 + [v] + [zero] * 2
    a, b = got["a"], got["b"]
    assert a.date == [f"Mar {d:02d}" for d in range(5, 12)]
    assert (a.session_count, b.session_count) == (fifth(4), fifth(2))
    assert (a.visitor_count, b.visitor_count) == (fifth(3), fifth(2))
    assert (a.goal_conversion_count, b.goal_conversion_count) == (fifth(2), fifth(1))
    assert (a.goal_conversion_percentage, b.goal_conversion_percentage) == (fifth(66.67, 0.0), fifth(50.0, 0.0))
    assert (a.sales_conversion_count, b.sales_conversion_count) == (fifth(1), fifth(1))
    assert (a.sales_conversion_percentage, b.sales_conversion_percentage) == (fifth(33.33, 0.0), fifth(50.0, 0.0))

    for r in series(table("events", [])).values():
        assert r.session_count == r.sales_conversion_count == [0] * 7


def verdict(lab, **kw):
    goals = variation.goal_table(lab["variations"], lab["events"])
    return summary.experiment_summary(lab["experiments"], lab["events"], goals, **kw)


def test_summary_golden(lab, table):
    r = verdict(lab).first()
    # Six served rows of the 1569 that two arms need, in 28 whole hours since the start.
    assert (r.status, r.best_variation, r.betterness_percentage) == ("pending", "name_a", 25.12)
    assert (r.remaining_sessions, r.remaining_days, r.recommendation) == (1563, 315, "continue")
    text = summary.summary_text(verdict(lab)).first()
    assert text.summary == "name_a leads by 25.12%." and "1563" in text.conclusion and "315" in text.conclusion

    for part in ("events", "variations"):
        assert verdict({**lab, part: table(part, [])}).first().status == "insufficient"
    one_arm = lab["variations"].filter(F.col("variation_id") == "a")
    assert verdict({**lab, "variations": one_arm}).first().status == "insufficient"


def many(arm, served, clicked):
    rows = [event(f"{arm}{i}", arm, "served", i) for i in range(served)]
    return rows + [event(f"{arm}{i}", arm, "clicked", i) for i in range(clicked)]


@pytest.mark.parametrize(
    "a,b,status,confidence",
    [
        ((800, 400), (800, 300), "winner", 99.99),
        ((800, 400), (800, 390), "no_clear_winner", 38.3),
        ((784, 400), (785, 300), "pending", None),
        ((784, 400), (786, 300), "winner", 99.99),
        ((800, 0), (800, 0), "no_clear_winner", None),
        ((2000, 400), (0, 0), "no_clear_winner", None),
    ],
)
def test_summary_states(lab, table, a, b, status, confidence):
    r = verdict({**lab, "events": table("events", many("a", *a) + many("b", *b))}).first()
    assert (r.status, r.confidence_percentage) == (status, confidence)
    assert r.recommendation == ("continue" if status == "pending" else "stop")


def test_summary_of_three_arms_multiplies_confidence(lab, table):
    lab["variations"] = table("variations", [{**KEY, "variation_id": v, "variation_name": v} for v in "abc"])
    lab["events"] = table("events", many("a", 800, 400) + many("b", 800, 380) + many("c", 800, 370))
    ev = summary.ab_evaluation(variation.goal_table(lab["variations"], lab["events"])).first()

    import math

    def conf(c1, c2, n=800):
        p = (c1 + c2) / (2 * n)
        x = (c1 / n - c2 / n) ** 2 / (p * (1 - p) * 2 / n)
        return math.erf(math.sqrt(x / 2))

    assert ev.confidence == pytest.approx(conf(400, 380) * conf(400, 370))
    rates = [c / 800.01 for c in (400, 380, 370)]
    assert ev.betterness == pytest.approx((rates[0] - (rates[1] + rates[2]) / 2) / rates[0])
    assert (ev.best_variation_id, ev.arms, ev.required_sessions) == ("a", 3, 1926)


def test_latest_experiment(table):
    rows = [
        ("a", "e2", "2020-01-02T00:00:00Z"),
        ("a", "e1", "2020-01-02T00:00:00Z"),
        ("a", "e0", "2020-01-01T00:00:00Z"),
        ("b", "x", "2019-01-01T00:00:00Z"),
        ("c", "y", None),
    ]
    df = table("experiments", [{"client_id": c, "experiment_id": e, "last_updation_time": t} for c, e, t in rows])
    assert rows_of(lookups.latest_experiment(df)) == [("a", "e1"), ("b", "x")]


def random_shop(seed):
    """Tangled carts, sessions and orders: one cart and one session hold a third of the rows."""
    rnd = random.Random(seed)

    def pick(prefix, n):
        return f"{prefix}0" if rnd.random() < 0.34 else f"{prefix}{rnd.randrange(n)}"

    def when():
        return (BASE + dt.timedelta(minutes=rnd.randrange(-3000, 3000))).isoformat()

    maybe = lambda v: None if rnd.random() < 0.1 else v
    client = lambda: rnd.choice(["k1", "k1", "k2"])
    cookies = [
        {"client_id": client(), "session_id": maybe(pick("s", 12)), "cart_token": maybe(pick("c", 10)), "creation_time": when()}
        for _ in range(120)
    ]
    events = [
        {
            "client_id": client(),
            "experiment_id": rnd.choice(["e1", "e2"]),
            "variation_id": rnd.choice("ab"),
            "session_id": maybe(pick("s", 12)),
            "event_name": rnd.choice(["served", "clicked"]),
            "creation_time": when(),
        }
        for _ in range(100)
    ]
    orders = [
        {
            "client_id": client(),
            "order_id": rnd.randrange(25),
            "cart_token": maybe(pick("c", 10)),
            "product_id": 1,
            "variant_id": rnd.randrange(4),
            "variant_quantity": rnd.randrange(1, 3),
            "variant_price": rnd.choice(["1.50", "2.25"]),
            "updated_at": when(),
            "payment_status": rnd.random() < 0.8,
        }
        for _ in range(150)
    ]
    experiments = [
        {"client_id": c, "experiment_id": e, "creation_time": (BASE + dt.timedelta(minutes=m)).isoformat()}
        for c, e, m in [("k1", "e1", -1500), ("k1", "e2", 500), ("k2", "e1", -4000)]
    ]
    return cookies, events, orders, experiments


def in_duckdb(**frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return con


@pytest.mark.parametrize("seed", range(3))
def test_attributed_sales_equals_row_level_joins(table, seed):
    cookies, events, orders, exps = random_shop(seed)
    c, e, o, x = table("cookies", cookies), table("events", events), table("orders", orders), table("experiments", exps)
    got = rows_of(sales.attributed_sales(o, c, e, lookups.experiment_start(x)).withColumn("total_order_value", F.col("total_order_value").cast("double")))
    con = in_duckdb(cookies=c, events=e, orders=o, experiments=x)
    want = con.execute("""
        SELECT client_id, experiment_id, variation_id, count(DISTINCT session_id), count(DISTINCT order_id),
            CAST(sum(variant_quantity * variant_price) AS DOUBLE)
        FROM (SELECT DISTINCT o.client_id, e.experiment_id, e.variation_id, c.session_id, o.order_id, o.cart_token,
                o.variant_id, o.variant_quantity, o.variant_price
            FROM orders o JOIN cookies c ON c.client_id = o.client_id AND c.cart_token = o.cart_token
            JOIN events e ON e.client_id = o.client_id AND e.session_id = c.session_id
            JOIN experiments x ON x.client_id = o.client_id AND x.experiment_id = e.experiment_id
            WHERE o.payment_status AND o.updated_at > x.creation_time)
        GROUP BY ALL""").fetchall()
    assert got == sorted(want)
    assert got


@pytest.mark.parametrize("seed", range(2))
def test_sales_by_day_equals_row_level_joins(table, seed):
    cookies, events, orders, _ = random_shop(seed)
    day = lambda df, t: df.withColumn("day", F.to_date(t))
    c, e, o = day(table("cookies", cookies), "creation_time"), day(table("events", events), "creation_time"), day(table("orders", orders), "updated_at")
    got = rows_of(sales.sales_by_day(o, c, e).withColumn("day", F.col("day").cast("string")))
    con = in_duckdb(cookies=c, events=e, orders=o)
    want = con.execute("""
        SELECT client_id, experiment_id, variation_id, CAST(day AS VARCHAR), count(DISTINCT session_id)
        FROM cookies c JOIN orders o USING (client_id, cart_token, day) JOIN events e USING (client_id, session_id, day)
        WHERE payment_status GROUP BY ALL""").fetchall()
    assert got == sorted(want)
    assert got


def test_assignment_is_sticky_stable_and_uniform(spark, lab, table):
    sessions = spark.range(6000).select(
        F.lit(shop.CLIENT).alias("client_id"), F.lit("exp").alias("experiment_id"), F.concat(F.lit("n"), "id").alias("session_id")
    )
    known = table("events", EVENTS).select("client_id", "experiment_id", "session_id").distinct()
    third = table("variations", [{**KEY, "variation_id": "c", "variation_name": "late"}])
    for variations, arms in [(lab["variations"], 2), (lab["variations"].unionByName(third), 3)]:
        got = ops.assign(sessions.unionByName(known), lab["events"], variations)
        again = ops.assign(sessions.repartition(3).unionByName(known), lab["events"], variations)
        assert got.exceptAll(again).isEmpty()
        kept = got.filter(~F.col("session_id").startswith("n"))
        assert rows_of(kept, "session_id", "variation_id") == [("p1", "a"), ("p2", "a"), ("p3", "a"), ("q1", "b"), ("q2", "b")]
        counts = [r["count"] for r in got.filter(F.col("session_id").startswith("n")).groupBy("variation_id").count().collect()]
        assert len(counts) == arms and sum(counts) == 6000
        assert all(abs(n - 6000 / arms) < 200 for n in counts)


def test_requests_without_variations_are_dropped(lab, table, spark):
    requests = spark.createDataFrame([("other", "exp", "z")], "client_id string, experiment_id string, session_id string")
    assert ops.assign(requests, lab["events"], lab["variations"]).isEmpty()


def test_an_assignment_meets_the_variations_once(spark, table):
    def arm(variation, experiment="e"):
        return {"client_id": "a", "experiment_id": experiment, "variation_id": variation}

    variations = table("variations", [arm("y"), arm("x"), arm("x"), arm(None), arm("z", "single")])
    events = table("events", [dict(arm("old"), session_id="s0", event_name="served", creation_time="2020-03-01T00:00:00Z")])
    requests = spark.createDataFrame(
        [("a", e, s) for e, s in (*(("e", f"s{i}") for i in range(40)), ("single", "s1"), ("none", "s1"), ("e", None))],
        "client_id string, experiment_id string, session_id string",
    )
    got = ops.assign(requests, events, variations)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 2
    slots = [None, "x", "x", "y"]
    taken = {f"s{i}": slots[int(hashlib.md5(f"s{i}|e".encode()).hexdigest()[:8], 16) % 4] for i in range(1, 40)}
    expected = {("e", s, v) for s, v in taken.items() if v} | {("e", "s0", "old"), ("single", "s1", "z")}
    assert {(r.experiment_id, r.session_id, r.variation_id) for r in got.collect()} == expected
