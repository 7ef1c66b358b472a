"""The registered queries as plain SQL over the driver's tables.

Written the direct way (row-level joins, DISTINCT, one step per line of the definition), so
that it shares no shortcut with the Spark jobs.
"""

from __future__ import annotations

import re

START, END = "2024-01-03 00:00:00", "2024-01-28 23:59:59"
NOW = "2024-01-15 07:30:00"


def _time(key: str) -> str:
    return f"make_timestamp((1704067200 + ({key} * 7919) % 2592000) * 1000000)"


def _text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def _local(col: str, zone: str) -> str:
    return f"timezone({zone}, timezone('UTC', {col}))"


def _utc(col: str, zone: str) -> str:
    return f"timezone('UTC', timezone({zone}, {col}))"


def _percent(n: str, d: str) -> str:
    q, r = f"(({n} * 10000) // {d})", f"(({n} * 10000) % {d})"
    up = f"CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({q} + {up} AS DOUBLE) / 100 END"


def _damped(n: str, d: str) -> str:
    base = f"({d} * 100 + 1)"
    return f"least(CAST(100 AS DOUBLE), CAST(({n} * 2000000 + {base}) // (2 * {base}) AS DOUBLE) / 100)"


def _mean(total: str, n: str) -> str:
    base = f"({n} * 100 + 1)"
    return f"CAST((CAST({total} * 100 AS BIGINT) * 200 + {base}) // (2 * {base}) AS DOUBLE) / 100"


def _tags(col: str) -> str:
    parts = f"list_distinct(list_transform(string_split({col}, ','), lambda x: trim(x)))"
    return f"CASE WHEN {col} = '' THEN ['no-tag'] ELSE {parts} END"


def _token(kind: str) -> str:
    return f"substring(sha256(concat('{kind}|', client_id, '|', order_id)), 1, 32)"


# Named building blocks. Each may use the driver's tables and other blocks.
VIEWS = {
    "clicks": """
        SELECT *, concat('c', user_id % 3) AS client_id, concat('s', user_id, '_', day(ts)) AS session_id
        FROM events""",
    "visits": """
        SELECT client_id, session_id,
            CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'collection'
                WHEN 'signup' THEN 'product' ELSE 'cart' END AS event_name,
            ts AS creation_time,
            CASE event_type WHEN 'view' THEN '/' WHEN 'click' THEN '/collections/all'
                WHEN 'signup' THEN concat('/products/part-', event_id % 50) ELSE '/cart' END AS url
        FROM clicks WHERE event_type <> 'purchase'""",
    "exp_events": """
        SELECT concat('v', (user_id % 10) % 3) AS variation_id, client_id, 'e1' AS experiment_id, session_id,
            CASE event_type WHEN 'view' THEN 'served' ELSE 'clicked' END AS event_name, ts AS creation_time
        FROM clicks WHERE event_type IN ('view', 'click')""",
    "visitors": """
        SELECT client_id, session_id, r_name AS region, concat('d', user_id % 3) AS device,
            concat('b', user_id % 4) AS browser, concat('o', user_id % 5) AS os, ts AS creation_time
        FROM clicks LEFT JOIN region ON user_id % 7 = r_regionkey
        WHERE event_type IN ('view', 'signup')""",
    "shop_orders": f"""
        SELECT concat('c', o_custkey % 3) AS client_id, o_orderkey AS order_id,
            concat('mail-', o_custkey) AS email_id, concat('cart-', o_orderkey) AS cart_token,
            l_partkey AS product_id, l_partkey * 10 + l_linenumber AS variant_id,
            CAST(l_quantity AS INTEGER) AS variant_quantity,
            CAST(l_extendedprice AS DECIMAL(8,2)) AS variant_price,
            {_time("o_orderkey")} AS updated_at, o_orderstatus <> 'P' AS payment_status,
            CASE o_orderkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/collections/all'
                WHEN 2 THEN concat('/products/part-', l_partkey) WHEN 3 THEN '/checkouts/x' END AS landing_page
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "cookies": f"""
        SELECT concat('c', o_custkey % 3) AS client_id,
            concat('s', o_custkey % 150, '_', day({_time("o_orderkey")})) AS session_id,
            concat('cart-', o_orderkey) AS cart_token, {_time("o_orderkey")} AS creation_time
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "products": f"""
        SELECT concat('c', p_partkey % 3) AS client_id, p_partkey AS product_id,
            concat(p_name, ' ', p_partkey) AS product_title, concat('part-', p_partkey) AS product_handle,
            p_partkey * 10 + 1 AS variant_id, 'Default Title' AS variant_title,
            CAST(p_retailprice AS DECIMAL(8,2)) AS variant_price, {_time("p_partkey")} AS updated_at,
            CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(p_type, ', ', p_brand) END AS tags
        FROM part""",
    "clients": """
        SELECT concat('c', c_custkey) AS client_id, c_name AS full_name, c_mktsegment AS company_name,
            c_acctbal < 0 AS disabled, concat('https://shop-', c_custkey, '.example') AS shopify_app_eg_url,
            CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Kolkata' ELSE 'America/New_York' END
                AS client_timezone,
            make_timestamp((1701475200 + c_custkey % 86400) * 1000000) AS creation_time
        FROM customer""",
    "experiments": """
        SELECT concat('c', c_custkey) AS client_id, e.*, c_mktsegment AS page_type,
            'split' AS experiment_type, 'active' AS status
        FROM customer, (VALUES
            ('e1', 'Hero banner', TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-20 00:00:00'),
            ('e0', 'Button colour', TIMESTAMP '2023-12-01 00:00:00', TIMESTAMP '2024-01-10 00:00:00')
        ) e(experiment_id, experiment_name, creation_time, last_updation_time)""",
    "variations": """
        SELECT concat('c', c_custkey) AS client_id, v.*
        FROM customer, (VALUES ('e1', 'v0', 'Control'), ('e1', 'v1', 'Variant A'), ('e1', 'v2', 'Variant B'),
            ('e0', 'w0', 'Only'), ('e1', 'v3', 'Never served')) v(experiment_id, variation_id, variation_name)
        WHERE v.variation_id <> 'v3' OR c_custkey % 2 = 1""",
    "bounds": f"""
        SELECT client_id, {_utc(f"TIMESTAMP '{START}'", "client_timezone")} AS lo,
            {_utc(f"TIMESTAMP '{END}'", "client_timezone")} AS hi
        FROM clients""",
    "visits_w": """
        SELECT v.* FROM visits v JOIN bounds USING (client_id) WHERE creation_time > lo AND creation_time < hi""",
    "orders_w": """
        SELECT o.* FROM shop_orders o JOIN bounds USING (client_id) WHERE updated_at > lo AND updated_at < hi""",
    "visitors_w": """
        SELECT v.* FROM visitors v JOIN bounds USING (client_id) WHERE creation_time > lo AND creation_time < hi""",
    # Feeds: documents of 0 to 3 line items per row of orders, already flat here.
    "feed_lines": f"""
        SELECT concat('c', o_custkey % 3) AS client_id, o_orderkey AS order_id, concat('mail-', o_custkey) AS email_id,
            CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN ''
                ELSE concat('cart-', o_orderkey) END AS given_token,
            o_orderkey % 997 + i AS product_id, (o_orderkey % 997 + i) * 10 + i AS variant_id,
            CAST(i AS INTEGER) AS variant_quantity, CAST(o_custkey % 500 + i AS DECIMAL(8,2)) AS variant_price,
            {_time("o_orderkey")} AS updated_at, o_orderstatus, '/' AS landing_page
        FROM (SELECT *, unnest(range(1, o_orderkey % 4 + 1)) AS i FROM orders)""",
    "order_lines": f"""
        SELECT client_id, order_id, email_id,
            CASE WHEN coalesce(given_token, '') = '' THEN {_token("cart")} ELSE given_token END AS cart_token,
            product_id, variant_id, variant_quantity, variant_price, updated_at, TRUE AS payment_status,
            landing_page, o_orderstatus
        FROM feed_lines""",
    "checkout_lines": """
        SELECT client_id, order_id, email_id, given_token AS cart_token, product_id, variant_id,
            variant_quantity, variant_price, updated_at, FALSE AS payment_status, landing_page, o_orderstatus
        FROM feed_lines""",
    "anonymous": f"""
        SELECT client_id, {_token("session")} AS session_id, {_token("cart")} AS cart_token, creation_time
        FROM (SELECT concat('c', o_custkey % 3) AS client_id, o_orderkey AS order_id,
                {_time("o_orderkey")} AS creation_time
            FROM orders WHERE o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderstatus <> 'P')""",
    "product_feed": f"""
        SELECT concat('c', p_partkey % 3) AS client_id, p_partkey AS product_id,
            concat(p_name, ' ', p_partkey) AS product_title, concat('part-', p_partkey) AS product_handle,
            p_partkey * 10 + i AS variant_id, concat('Size ', i) AS variant_title,
            CAST(CAST(p_retailprice AS DECIMAL(8,2)) + i AS DECIMAL(8,2)) AS variant_price,
            {_time("p_partkey")} AS updated_at, p_type AS tags
        FROM part, (VALUES (1), (2)) v(i)""",
    "raw_cookies": """
        SELECT concat('c', l_orderkey % 3) AS client_id, concat('s', l_suppkey % 150) AS session_id,
            CASE l_returnflag WHEN 'R' THEN '' ELSE concat('cart-', l_orderkey) END AS cart_token,
            make_timestamp((1704067200 + (l_orderkey * 7919) % 2592000 + l_linenumber) * 1000000) AS creation_time
        FROM lineitem""",
    "unique_cookies": """
        SELECT client_id, session_id, cart_token, min(creation_time) AS creation_time
        FROM raw_cookies WHERE cart_token <> '' GROUP BY ALL""",
    "new_cookies": """
        SELECT * FROM unique_cookies u WHERE NOT EXISTS (SELECT 1 FROM cookies c
            WHERE c.client_id = u.client_id AND c.session_id = u.session_id AND c.cart_token = u.cart_token)""",
    # Experiments.
    "event_counts": """
        SELECT s.client_id, s.experiment_id, s.variation_id, s.num_session, s.num_visitor,
            coalesce(c.n, 0) AS goal_conversion_count
        FROM (SELECT client_id, experiment_id, variation_id, count(DISTINCT session_id) AS n
            FROM exp_events WHERE event_name = 'clicked' GROUP BY ALL) c
        FULL OUTER JOIN (SELECT client_id, experiment_id, variation_id, count(session_id) AS num_session,
                count(DISTINCT session_id) AS num_visitor
            FROM exp_events WHERE event_name = 'served' GROUP BY ALL) s
        ON c.client_id = s.client_id AND c.experiment_id = s.experiment_id AND c.variation_id = s.variation_id
        WHERE s.variation_id IS NOT NULL""",
    "sales_rows": """
        SELECT DISTINCT o.client_id, e.experiment_id, e.variation_id, c.session_id, o.order_id, o.cart_token,
            o.variant_id, o.variant_quantity, o.variant_price
        FROM shop_orders o
        LEFT JOIN cookies c ON c.client_id = o.client_id AND c.cart_token = o.cart_token
        JOIN exp_events e ON e.client_id = o.client_id AND e.session_id = c.session_id
        JOIN experiments x ON x.client_id = o.client_id AND x.experiment_id = e.experiment_id
        WHERE o.payment_status AND o.updated_at > x.creation_time""",
    "sales": """
        SELECT client_id, experiment_id, variation_id, count(DISTINCT session_id) AS sales_conversion_count,
            count(DISTINCT order_id) AS order_count, sum(variant_quantity * variant_price) AS total_order_value
        FROM sales_rows GROUP BY ALL""",
    "table_counts": """
        SELECT v.client_id, v.experiment_id, v.variation_id, v.variation_name,
            coalesce(num_session, 0) AS num_session, coalesce(num_visitor, 0) AS num_visitor,
            coalesce(goal_conversion_count, 0) AS goal_conversion_count,
            coalesce(sales_conversion_count, 0) AS sales_conversion_count,
            coalesce(order_count, 0) AS order_count, coalesce(total_order_value, 0) AS total_order_value
        FROM variations v
        LEFT JOIN event_counts USING (client_id, experiment_id, variation_id)
        LEFT JOIN sales USING (client_id, experiment_id, variation_id)""",
    "days": f"""
        SELECT client_id, client_timezone, CAST({_local(f"TIMESTAMP '{NOW}'", "client_timezone")} AS DATE) AS today,
            today - 6 + CAST(unnest(range(0, 7)) AS INTEGER) AS day
        FROM clients""",
    "events_d": f"""
        SELECT e.*, CAST({_local("e.creation_time", "client_timezone")} AS DATE) AS day
        FROM exp_events e JOIN clients USING (client_id)
        WHERE e.creation_time < TIMESTAMP '{NOW}'""",
    "orders_d": f"""
        SELECT o.*, CAST({_local("updated_at", "client_timezone")} AS DATE) AS day
        FROM shop_orders o JOIN clients USING (client_id) WHERE updated_at < TIMESTAMP '{NOW}'""",
    "cookies_d": f"""
        SELECT c.*, CAST({_local("c.creation_time", "client_timezone")} AS DATE) AS day
        FROM cookies c JOIN clients USING (client_id) WHERE c.creation_time < TIMESTAMP '{NOW}'""",
    "day_counts": """
        SELECT client_id, experiment_id, variation_id, day,
            count(session_id) FILTER (event_name = 'served') AS num_session,
            count(DISTINCT session_id) FILTER (event_name = 'served') AS num_visitor,
            count(DISTINCT session_id) FILTER (event_name = 'clicked') AS goal_conversion_count
        FROM events_d JOIN days USING (client_id, day) GROUP BY ALL""",
    "day_sales": """
        SELECT client_id, e.experiment_id, e.variation_id, day,
            count(DISTINCT c.session_id) AS sales_conversion_count
        FROM cookies_d c
        JOIN orders_d o USING (client_id, cart_token, day)
        JOIN events_d e USING (client_id, session_id, day)
        JOIN days USING (client_id, day)
        WHERE o.payment_status GROUP BY ALL""",
    "over_time": f"""
        SELECT *, {_percent("goal_conversion_count", "visitor_count")} AS goal_conversion_percentage,
            {_percent("sales_conversion_count", "visitor_count")} AS sales_conversion_percentage
        FROM (SELECT v.client_id, v.experiment_id, v.variation_id, v.variation_name, day,
                strftime(day, '%b %d') AS date, coalesce(num_session, 0) AS session_count,
                greatest(coalesce(num_visitor, 0), coalesce(goal_conversion_count, 0),
                    coalesce(sales_conversion_count, 0)) AS visitor_count,
                coalesce(goal_conversion_count, 0) AS goal_conversion_count,
                coalesce(sales_conversion_count, 0) AS sales_conversion_count
            FROM variations v JOIN days USING (client_id)
            LEFT JOIN day_counts USING (client_id, experiment_id, variation_id, day)
            LEFT JOIN day_sales USING (client_id, experiment_id, variation_id, day))""",
    "span": """
        SELECT x.client_id, x.experiment_id, x.creation_time AS start_time, max(e.creation_time) AS end_time
        FROM experiments x LEFT JOIN exp_events e
            ON e.client_id = x.client_id AND e.experiment_id = x.experiment_id
        GROUP BY ALL""",
    "rates": """
        SELECT *, goal_conversion_count / (num_visitor + CAST(0.01 AS DOUBLE)) AS rate FROM table_counts""",
    "best": """
        SELECT client_id, experiment_id, variation_id AS best_variation_id, variation_name AS best_variation,
            rate AS best_rate, goal_conversion_count AS bc, num_visitor AS bn
        FROM rates QUALIFY row_number() OVER (PARTITION BY client_id, experiment_id
            ORDER BY rate DESC, variation_id) = 1""",
    "pairs": """
        SELECT r.client_id, r.experiment_id, rate,
            CASE WHEN bn = 0 OR num_visitor = 0 OR bc + goal_conversion_count IN (0, bn + num_visitor) THEN NULL
            ELSE power(bc / bn - goal_conversion_count / num_visitor, 2)
                / ((bc + goal_conversion_count) / (bn + num_visitor)
                    * (1 - (bc + goal_conversion_count) / (bn + num_visitor))
                    * (1 / bn + 1 / num_visitor)) END AS x
        FROM rates r JOIN best b ON b.client_id = r.client_id AND b.experiment_id = r.experiment_id
        WHERE r.variation_id <> best_variation_id""",
    # The error function as a series of positive terms.
    "pair_confidence": """
        SELECT *, CASE WHEN x <= 0 THEN 0 ELSE list_sum(list_transform(range(0, 400),
            lambda n: exp(-x / 2 + (2 * n + 1) * ln(sqrt(x / 2)) - lgamma(n + 1.5)))) END AS confidence
        FROM pairs""",
    "evaluation": """
        SELECT t.*, best_variation_id, best_variation, best_rate,
            CASE WHEN bad = 0 THEN chi END AS chi_square_sum, CASE WHEN bad = 0 THEN conf END AS confidence,
            CASE WHEN best_rate > 0 THEN (best_rate - other / (arms - 1)) / best_rate END AS betterness,
            CASE arms WHEN 2 THEN 1569 WHEN 3 THEN 1926 WHEN 4 THEN 2180 WHEN 5 THEN 2387 END AS required_sessions
        FROM (SELECT client_id, experiment_id, count(*) AS arms, sum(num_session) AS sessions,
                sum(num_visitor) AS visitors FROM rates GROUP BY ALL) t
        JOIN best USING (client_id, experiment_id)
        LEFT JOIN (SELECT client_id, experiment_id, count(*) FILTER (x IS NULL) AS bad, sum(x) AS chi,
                product(confidence) AS conf, CAST(sum(CAST(rate AS DECIMAL(38,18))) AS DOUBLE) AS other
            FROM pair_confidence GROUP BY ALL) USING (client_id, experiment_id)""",
    "verdict": """
        SELECT *, required_sessions - sessions AS remaining,
            CAST(floor((epoch(end_time) - epoch(start_time)) / 3600) AS BIGINT) AS num_hour,
            round(least(confidence * 100, 99.99), 2) AS confidence_percentage,
            CASE WHEN NOT (coalesce(visitors, 0) > 0 AND end_time IS NOT NULL AND arms > 1) THEN 'insufficient'
                WHEN required_sessions - sessions >= 0 THEN 'pending'
                WHEN confidence IS NOT NULL AND round(least(confidence * 100, 99.99), 2) > 95 THEN 'winner'
                ELSE 'no_clear_winner' END AS status
        FROM span LEFT JOIN evaluation USING (client_id, experiment_id)""",
    "requests": """
        SELECT client_id, session_id, min(creation_time) AS creation_time, 'e1' AS experiment_id
        FROM (SELECT client_id, session_id, creation_time FROM visits
            UNION ALL SELECT client_id, session_id, creation_time FROM cookies)
        GROUP BY client_id, session_id""",
    "sticky": """
        SELECT client_id, experiment_id, session_id, variation_id AS kept
        FROM exp_events QUALIFY row_number() OVER (PARTITION BY client_id, experiment_id, session_id
            ORDER BY creation_time, variation_id) = 1""",
    "slots": """
        SELECT client_id, experiment_id, variation_id AS fresh,
            row_number() OVER (PARTITION BY client_id, experiment_id ORDER BY variation_id) - 1 AS slot,
            count(*) OVER (PARTITION BY client_id, experiment_id) AS arms
        FROM variations""",
    # Visitors.
    "order_total": """
        SELECT o.client_id, order_id, min(session_id) AS session_id,
            sum(variant_quantity * variant_price) AS total_order_value
        FROM shop_orders o LEFT JOIN (SELECT client_id, cart_token, min(session_id) AS session_id
            FROM cookies GROUP BY ALL) c USING (client_id, cart_token)
        WHERE payment_status GROUP BY ALL""",
    "order_total_w": """
        SELECT o.client_id, order_id, min(session_id) AS session_id,
            sum(variant_quantity * variant_price) AS total_order_value
        FROM orders_w o LEFT JOIN (SELECT client_id, cart_token, min(session_id) AS session_id
            FROM cookies GROUP BY ALL) c USING (client_id, cart_token)
        WHERE payment_status GROUP BY ALL""",
    "visit_orders": """
        SELECT v.client_id, v.session_id, device, browser, os, region, order_id,
            coalesce(total_order_value, 0) AS total
        FROM visitors_w v LEFT JOIN order_total_w t ON t.client_id = v.client_id AND t.session_id = v.session_id""",
}


def _measures(dimension: str) -> str:
    """The measures of one attribute, by row-level grouping and distinct rows."""
    return f"""
        SELECT s.client_id, s.value, s.session_count, s.visitor_count,
            coalesce(c.sales_conversion_count, 0) AS sales_conversion_count,
            coalesce(c.order_count, 0) AS order_count, coalesce(c.total_sales, 0) AS total_sales
        FROM (SELECT client_id, {dimension} AS value, count(*) AS session_count,
                count(DISTINCT session_id) AS visitor_count
            FROM visit_orders WHERE {dimension} IS NOT NULL GROUP BY ALL) s
        LEFT JOIN (SELECT client_id, {dimension} AS value, count(DISTINCT session_id) AS sales_conversion_count,
                count(DISTINCT order_id) AS order_count, sum(total) AS total_sales
            FROM (SELECT DISTINCT * FROM visit_orders WHERE order_id IS NOT NULL) GROUP BY ALL) c
        ON c.client_id = s.client_id AND c.value = s.value"""


def _with_rates(body: str, keys: str) -> str:
    return f"""
        SELECT {keys}, CAST(session_count AS BIGINT) AS session_count, CAST(visitor_count AS BIGINT) AS visitor_count,
            CAST(sales_conversion_count AS BIGINT) AS sales_conversion_count,
            CAST(order_count AS BIGINT) AS order_count, CAST(total_sales AS DOUBLE) AS total_sales,
            {_damped("sales_conversion_count", "visitor_count")} AS sales_conversion,
            {_mean("total_sales", "order_count")} AS avg_order_value
        FROM ({body})"""


_ORDER_COLUMNS = f"""client_id, order_id, email_id, cart_token, product_id, variant_id, variant_quantity,
    CAST(variant_price AS DOUBLE) AS variant_price, {_text("updated_at")} AS updated_at, payment_status, landing_page"""
_PRODUCT_COLUMNS = f"""client_id, product_id, product_title, product_handle, variant_id, variant_title,
    CAST(variant_price AS DOUBLE) AS variant_price, {_text("updated_at")} AS updated_at, tags"""
_EVENT_KEY = "variation_id, client_id, experiment_id, session_id, event_name"
_SECOND = "date_trunc('second', creation_time)"

_STEPS = """(VALUES (1, 'Home Page'), (2, 'Collection Page'), (3, 'Product Page'), (4, 'Cart Page'),
        (5, 'Checkout Page'), (6, 'Purchase')) s(step_id, page)"""

_STEP_COUNTS = """
    SELECT client_id, 1 AS step_id, count(DISTINCT session_id) AS n FROM visits_w
        WHERE event_name = 'home' GROUP BY client_id
    UNION SELECT client_id, 2, count(DISTINCT session_id) FROM visits_w
        WHERE event_name = 'collection' GROUP BY client_id
    UNION SELECT client_id, 3, count(DISTINCT session_id) FROM visits_w
        WHERE event_name = 'product' GROUP BY client_id
    UNION SELECT client_id, 4, count(DISTINCT session_id) FROM visits_w
        WHERE event_name = 'cart' GROUP BY client_id
    UNION SELECT client_id, 5, count(DISTINCT order_id) FROM orders_w GROUP BY client_id
    UNION SELECT client_id, 6, count(DISTINCT order_id) FROM orders_w WHERE payment_status GROUP BY client_id"""

_FUNNEL = f"""
    SELECT client_id, step_id, page, coalesce(n, 0) AS visitor_count,
        max(coalesce(n, 0)) OVER (PARTITION BY client_id) AS top
    FROM (SELECT client_id, s.* FROM clients, {_STEPS}) LEFT JOIN ({_STEP_COUNTS}) USING (client_id, step_id)"""

_FUNNEL_ROWS = f"""
    SELECT client_id, step_id, page, visitor_count, {_percent("visitor_count", "top")} AS percentage FROM ({_FUNNEL})"""

_LANDING_TOUCH = """
    SELECT client_id, session_id, event_name, creation_time AS first_time FROM visits_w
    WHERE event_name IN ('home', 'collection', 'product')
    QUALIFY row_number() OVER (PARTITION BY client_id, session_id ORDER BY creation_time, event_name) = 1"""

_LANDING_ORDERS = """
    SELECT client_id, CASE WHEN landing_page LIKE '%product%' OR landing_page LIKE '%checkout%' THEN 'product'
        WHEN landing_page LIKE '%collection%' THEN 'collection' ELSE 'home' END AS page_type,
        count(*) AS conversion_count
    FROM orders_w WHERE payment_status GROUP BY ALL"""

_LANDING = f"""
    SELECT client_id, page_id, page, any_seen, greatest(v - c, 0) AS non_conversion_count, c AS conversion_count,
        {_percent("c", "greatest(v, c)")} AS conversion_percentage
    FROM (SELECT k.client_id, p.page_id, p.page, coalesce(t.n, 0) AS v, coalesce(o.conversion_count, 0) AS c,
            max(coalesce(t.n, o.conversion_count)) OVER (PARTITION BY k.client_id) IS NOT NULL AS any_seen
        FROM clients k, (VALUES (1, 'home', 'Home Page'), (2, 'collection', 'Collections Page'),
            (3, 'product', 'Product Page')) p(page_id, kind, page)
        LEFT JOIN (SELECT client_id, event_name, count(*) AS n FROM ({_LANDING_TOUCH}) GROUP BY ALL) t
            ON t.client_id = k.client_id AND t.event_name = p.kind
        LEFT JOIN ({_LANDING_ORDERS}) o ON o.client_id = k.client_id AND o.page_type = p.kind)"""

_PRODUCT_VISITS = """
    SELECT client_id, trim(string_split(url, '/')[-1]) AS product_handle, CAST(sum(n) AS BIGINT) AS visitor_count
    FROM (SELECT client_id, url, count(DISTINCT session_id) AS n FROM visits_w
        WHERE event_name = 'product' GROUP BY ALL)
    GROUP BY ALL"""

_PRODUCT_ORDERS = """
    SELECT client_id, product_id, count(DISTINCT order_id) AS conversion_count
    FROM orders_w WHERE payment_status GROUP BY ALL"""

_PRODUCT = f"""
    SELECT client_id, product_id, product_title, product_handle, tags, greatest(v - c, 0) AS non_conversion_count,
        c AS conversion_count, {_percent("c", "greatest(v, c)")} AS conversion_percentage
    FROM (SELECT p.*, coalesce(visitor_count, 0) AS v, coalesce(conversion_count, 0) AS c
        FROM (SELECT DISTINCT client_id, product_title, product_handle, product_id, tags FROM products) p
        LEFT JOIN ({_PRODUCT_VISITS}) USING (client_id, product_handle)
        LEFT JOIN ({_PRODUCT_ORDERS}) USING (client_id, product_id))"""

_PRODUCT_TAG = f"""
    SELECT client_id, product_id, product_title, product_handle, non_conversion_count, conversion_count,
        conversion_percentage, unnest({_tags("tags")}) AS tag
    FROM ({_PRODUCT})"""

_TABLE = f"""
    SELECT client_id, experiment_id, variation_id, variation_name, num_session, num_visitor, goal_conversion_count,
        sales_conversion_count, order_count, CAST(total_order_value AS DOUBLE) AS total_order_value,
        {_damped("goal_conversion_count", "num_visitor")} AS goal_conversion,
        {_damped("sales_conversion_count", "num_visitor")} AS sales_conversion,
        {_mean("total_order_value", "order_count")} AS avg_total_order_value
    FROM table_counts"""


def _assigned(requests: str) -> str:
    return f"""
        SELECT r.client_id, r.experiment_id, r.session_id, r.creation_time, coalesce(kept, fresh) AS variation_id
        FROM {requests} r
        LEFT JOIN sticky USING (client_id, experiment_id, session_id)
        LEFT JOIN slots s ON s.client_id = r.client_id AND s.experiment_id = r.experiment_id
            AND s.slot = CAST(concat('0x', substring(md5(concat(r.session_id, '|', r.experiment_id)), 1, 8)) AS BIGINT)
                % s.arms"""


_UPSERT = """
    SELECT * FROM shop_orders s WHERE payment_status AND NOT EXISTS (SELECT 1 FROM orders o
        WHERE o.o_orderkey = s.order_id AND concat('c', o.o_custkey % 3) = s.client_id AND o_orderstatus IN ('F', 'P'))
    UNION ALL SELECT * EXCLUDE (o_orderstatus) FROM order_lines WHERE o_orderstatus = 'F'
    UNION ALL SELECT * EXCLUDE (o_orderstatus) FROM checkout_lines WHERE o_orderstatus = 'P'"""

_STALE = """
    SELECT * FROM shop_orders s WHERE EXISTS (SELECT 1 FROM orders o
        WHERE o.o_orderkey = s.order_id AND concat('c', o.o_custkey % 3) = s.client_id AND (
            o_orderstatus NOT IN ('F', 'P') OR (o_orderkey % 3 = 0 AND (o_orderstatus = 'F' OR o_orderkey % 7 <> 1))))
    UNION ALL SELECT * EXCLUDE (o_orderstatus) REPLACE (CASE WHEN order_id % 3 = 0 THEN updated_at - INTERVAL 1 DAY
            ELSE updated_at END AS updated_at)
        FROM (SELECT * FROM order_lines WHERE o_orderstatus = 'F'
            UNION ALL SELECT * FROM checkout_lines WHERE o_orderstatus = 'P' AND order_id % 7 <> 1)
        WHERE order_id % 3 <> 0 OR order_id NOT IN (SELECT l_orderkey FROM lineitem)"""

# Deliveries of the late stream: thirds of the minutes, each with rows of all days.
_DELIVERED = """
    SELECT e.*, minute(creation_time) % 3 AS k, (SELECT max(f.creation_time) - INTERVAL 1 DAY FROM exp_events f
        WHERE minute(f.creation_time) % 3 < minute(e.creation_time) % 3) AS mark
    FROM exp_events e"""
_MARKED = f"""
    SELECT *, coalesce(CAST(CAST(creation_time AS DATE) + 1 AS TIMESTAMP) <= mark, FALSE) AS late FROM ({_DELIVERED})"""

_VISIT_INGEST = f"SELECT client_id, session_id, event_name, url, {_text(_SECOND)} AS creation_time FROM visits"

_PRODUCT_UPSERT = """
    SELECT * FROM products p WHERE NOT EXISTS (SELECT 1 FROM product_feed f
        WHERE f.client_id = p.client_id AND f.variant_id = p.variant_id)
    UNION ALL SELECT * FROM product_feed"""

_DAY_COLUMNS = "client_id, experiment_id, variation_id, CAST(day AS VARCHAR) AS day"

_BY_REGION = _with_rates(
    f"""
    SELECT g.client_id, g.region_name, g.id, 'Feature' AS type, coalesce(session_count, 0) AS session_count,
        coalesce(visitor_count, 0) AS visitor_count, coalesce(sales_conversion_count, 0) AS sales_conversion_count,
        coalesce(order_count, 0) AS order_count, coalesce(total_sales, 0) AS total_sales
    FROM (SELECT client_id, r_name AS region_name, CAST(r_regionkey AS VARCHAR) AS id
        FROM (SELECT DISTINCT client_id FROM visitors_w), region) g
    LEFT JOIN ({_measures("region")}) m ON m.client_id = g.client_id AND m.value = g.region_name""",
    "client_id, region_name, id, type",
)

_DAILY_VISITORS = """
        SELECT CAST(CAST(creation_time AS DATE) AS VARCHAR) AS day, client_id, experiment_id, variation_id,
            count(session_id) FILTER (event_name = 'served') AS num_session,
            count(DISTINCT session_id) FILTER (event_name = 'served') AS num_visitor,
            count(DISTINCT session_id) FILTER (event_name = 'clicked') AS goal_conversion_count
        FROM exp_events GROUP BY ALL"""

BODIES = {
    "order_feed_flatten": f"""
        SELECT {_ORDER_COLUMNS} FROM (SELECT * FROM order_lines WHERE o_orderstatus <> 'P'
            UNION ALL SELECT * FROM checkout_lines WHERE o_orderstatus = 'P')""",
    "checkout_feed_flatten": f"SELECT {_ORDER_COLUMNS} FROM checkout_lines WHERE o_orderstatus = 'P'",
    "product_feed_flatten": f"SELECT {_PRODUCT_COLUMNS} FROM product_feed",
    "order_watermark": f"""
        SELECT client_id, {_text("max(updated_at) + INTERVAL 1 SECOND")} AS watermark
        FROM shop_orders WHERE payment_status GROUP BY client_id""",
    "product_watermark": f"SELECT client_id, {_text('max(updated_at)')} AS watermark FROM products GROUP BY client_id",
    "incremental_orders": f"""
        SELECT {_ORDER_COLUMNS} FROM order_lines LEFT JOIN (
            SELECT client_id, max(updated_at) + INTERVAL 1 SECOND AS watermark FROM shop_orders
            WHERE payment_status AND updated_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY client_id
        ) USING (client_id)
        WHERE o_orderstatus <> 'P' AND (watermark IS NULL OR updated_at >= watermark)""",
    "order_upsert": f"SELECT {_ORDER_COLUMNS} FROM ({_UPSERT})",
    "order_upsert_stale": f"SELECT {_ORDER_COLUMNS} FROM ({_STALE})",
    "stream_order_upsert_stale": f"SELECT {_ORDER_COLUMNS} FROM ({_STALE})",
    "order_upsert_stored": f"SELECT {_ORDER_COLUMNS} FROM ({_UPSERT})",
    "product_upsert_stored": f"SELECT {_PRODUCT_COLUMNS} FROM ({_PRODUCT_UPSERT})",
    "client_create": f"""
        SELECT concat('c', c_custkey) AS client_id, c_name AS full_name, c_mktsegment AS company_name,
            c_acctbal < 0 AS disabled, concat('https://shop-', c_custkey, '.example') AS shopify_app_eg_url,
            'UTC' AS client_timezone, {_text(_time("c_custkey"))} AS creation_time
        FROM customer""",
    "variation_create": """
        SELECT md5(concat('c', c_custkey, '|e1|', variation_name)) AS variation_id, variation_name,
            concat('c', c_custkey) AS client_id, 'e1' AS experiment_id, CAST(share AS INTEGER) AS traffic_percentage
        FROM customer, (VALUES ('Red', 60), ('Blue', 40)) v(variation_name, share)""",
    "rejected_orders": """
        SELECT client_id, order_id, variant_id, 'variant_quantity' AS missing
        FROM order_lines WHERE o_orderstatus <> 'P' AND variant_quantity = 2""",
    "unreadable_pages": """
        SELECT concat('c', o_custkey % 3) AS client_id, substr(concat('{"orders":[{"id":', o_orderkey, ',"email":"'), 1, 20) AS unreadable
        FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 1""",
    "stream_order_upsert_split": f"SELECT {_ORDER_COLUMNS} FROM ({_UPSERT.replace('payment_status AND', '')})",
    "visit_append": f"{_VISIT_INGEST} UNION ALL {_VISIT_INGEST}",
    "product_upsert": f"SELECT {_PRODUCT_COLUMNS} FROM ({_PRODUCT_UPSERT})",
    "event_ingest": f"SELECT {_EVENT_KEY}, {_text(_SECOND)} AS creation_time FROM exp_events",
    "visit_ingest": _VISIT_INGEST,
    "visitor_ingest": f"""
        SELECT client_id, session_id, region, device, browser, os, {_text(_SECOND)} AS creation_time
        FROM (SELECT * FROM visitors UNION ALL SELECT * FROM visitors)""",
    "visitor_append": f"""
        SELECT client_id, session_id, region, device, browser, os, {_text(_SECOND)} AS creation_time
        FROM (SELECT * FROM visitors UNION ALL SELECT * FROM visitors)""",
    "cookie_dedup": f"SELECT client_id, session_id, cart_token, {_text('creation_time')} AS creation_time FROM new_cookies",
    "event_insert_if_absent": f"""
        SELECT 'v0' AS variation_id, client_id, 'e1' AS experiment_id, session_id, 'served' AS event_name,
            {_text("min(creation_time)")} AS creation_time
        FROM cookies c WHERE NOT EXISTS (SELECT 1 FROM exp_events e
            WHERE e.client_id = c.client_id AND e.session_id = c.session_id)
        GROUP BY client_id, session_id""",
    "anonymous_cart": f"SELECT client_id, session_id, cart_token, {_text('creation_time')} AS creation_time FROM anonymous",
    "anonymous_served_backfill": f"""
        SELECT variation_id, client_id, experiment_id, session_id, 'served' AS event_name,
            {_text("creation_time")} AS creation_time
        FROM ({_assigned("(SELECT *, 'e1' AS experiment_id FROM anonymous)")})""",
    "dim_load": f"""
        SELECT md5(concat('c', c_custkey, '|', c_name, '|', 1704067200 + (c_custkey * 7919) % 2592000)) AS experiment_id,
            concat('c', c_custkey) AS client_id, c_name AS experiment_name, c_mktsegment AS page_type,
            'split' AS experiment_type, 'active' AS status, {_text(_time("c_custkey"))} AS creation_time,
            {_text(_time("c_custkey"))} AS last_updation_time, {_text(_time("c_custkey"))} AS start_time,
            {_text(_time("c_custkey"))} AS end_time
        FROM customer""",
    "json_roundtrip": f"SELECT {_ORDER_COLUMNS} FROM order_lines",
    "visits_window": f"""
        SELECT client_id, session_id, event_name, url, {_text("creation_time")} AS creation_time FROM visits_w""",
    "client_list": """
        SELECT * REPLACE (strftime(creation_time, '%Y-%m-%d') AS creation_time) FROM clients""",
    "experiment_list": """
        SELECT * REPLACE (strftime(creation_time, '%d-%b-%Y') AS creation_time,
            strftime(last_updation_time, '%d-%b-%Y') AS last_updation_time) FROM experiments""",
    "variation_list": "SELECT * FROM variations",
    "latest_experiment": """
        SELECT client_id, experiment_id FROM experiments x WHERE last_updation_time =
            (SELECT max(last_updation_time) FROM experiments y WHERE y.client_id = x.client_id)""",
    "union_distinct": """
        SELECT client_id, session_id FROM visits UNION SELECT client_id, session_id FROM cookies""",
    "time_formats": f"""
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(ts, '%d-%b-%Y') AS experiment_date,
            strftime({_local("ts", "'Asia/Kolkata'")}, '%Y-%m-%d') AS local_date,
            strftime({_local("ts", "'America/New_York'")}, '%b %d') AS short_day,
            {_text(_utc("date_trunc('second', ts)", "'Asia/Kolkata'"))} AS bound_utc,
            {_text(_utc("CAST(CAST(ts AS DATE) AS TIMESTAMP)", "'America/New_York'"))} AS day_start_utc,
            CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 14400 AS epoch
        FROM events""",
    "day_grid": f"""
        SELECT client_id, CAST(day AS VARCHAR) AS day, strftime(day, '%b %d') AS label,
            {_text(_utc("CAST(day AS TIMESTAMP)", "client_timezone"))} AS start_time,
            CASE WHEN day = today THEN {_text(f"TIMESTAMP '{NOW}'")}
                ELSE {_text(_utc("CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND", "client_timezone"))} END AS end_time
        FROM days""",
    "day_variation_grid": f"""
        SELECT {_DAY_COLUMNS}, variation_name FROM variations JOIN days USING (client_id)""",
    "shop_funnel": _FUNNEL_ROWS,
    "shop_funnel_union": f"""
        SELECT client_id, step_id, page, n AS visitor_count FROM ({_STEP_COUNTS}) JOIN {_STEPS} USING (step_id)""",
    "funnel_churn": f"""
        SELECT client_id, CASE WHEN seen > 0 THEN 'enough' ELSE 'not_enough' END AS status,
            CASE WHEN seen > 0 THEN page END AS page, CASE WHEN seen > 0 THEN round(gap, 2) END AS drop
        FROM (SELECT *, percentage - lead(percentage) OVER (PARTITION BY client_id ORDER BY step_id) AS gap,
                sum(visitor_count) FILTER (step_id <= 4) OVER (PARTITION BY client_id) AS seen
            FROM ({_FUNNEL_ROWS}))
        WHERE step_id < 6 QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY gap DESC, step_id) = 1""",
    "landing_first_touch": f"""
        SELECT client_id, session_id, event_name, {_text("first_time")} AS first_time FROM ({_LANDING_TOUCH})""",
    "landing_orders": _LANDING_ORDERS,
    "landing_page_conversion": f"SELECT * EXCLUDE (any_seen) FROM ({_LANDING})",
    "landing_worst": f"""
        SELECT client_id, CASE WHEN any_seen THEN 'enough' ELSE 'not_enough' END AS status,
            CASE WHEN any_seen THEN page END AS page,
            CASE WHEN any_seen THEN conversion_percentage END AS conversion_percentage
        FROM ({_LANDING})
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY conversion_percentage, page_id) = 1""",
    "product_visits": _PRODUCT_VISITS,
    "product_orders": _PRODUCT_ORDERS,
    "product_dim": "SELECT DISTINCT client_id, product_title, product_handle, product_id, tags FROM products",
    "product_tags": f"""
        SELECT client_id, tag, concat(CASE tag WHEN 'no-tag' THEN '1' ELSE '0' END, tag) AS tag_rank
        FROM (SELECT DISTINCT client_id, unnest({_tags("tags")}) AS tag FROM products)""",
    "product_conversion": _PRODUCT,
    "product_conversion_by_tag": _PRODUCT_TAG,
    "product_worst_by_tag": f"""
        SELECT client_id, tag, 'enough' AS status, product_title, conversion_percentage FROM ({_PRODUCT_TAG})
        QUALIFY row_number() OVER (PARTITION BY client_id, tag
            ORDER BY conversion_percentage, product_handle, product_id) = 1""",
    "variation_event_counts": "SELECT * FROM event_counts",
    "events_by_day": f"""
        SELECT {_DAY_COLUMNS}, num_session, num_visitor, goal_conversion_count FROM day_counts""",
    "sales_by_day": f"SELECT {_DAY_COLUMNS}, sales_conversion_count FROM day_sales",
    "conversion_over_time": "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM over_time",
    "conversion_series": """
        SELECT client_id, experiment_id, variation_id, variation_name,
            string_agg(date, ',' ORDER BY day) AS date,
            string_agg(CAST(session_count AS VARCHAR), ',' ORDER BY day) AS session_count,
            string_agg(CAST(visitor_count AS VARCHAR), ',' ORDER BY day) AS visitor_count,
            string_agg(CAST(goal_conversion_count AS VARCHAR), ',' ORDER BY day) AS goal_conversion_count,
            string_agg(CAST(goal_conversion_percentage AS VARCHAR), ',' ORDER BY day) AS goal_conversion_percentage,
            string_agg(CAST(sales_conversion_count AS VARCHAR), ',' ORDER BY day) AS sales_conversion_count,
            string_agg(CAST(sales_conversion_percentage AS VARCHAR), ',' ORDER BY day) AS sales_conversion_percentage
        FROM over_time GROUP BY client_id, experiment_id, variation_id, variation_name""",
    "attributed_sales": "SELECT * REPLACE (CAST(total_order_value AS DOUBLE) AS total_order_value) FROM sales",
    "conversion_table": _TABLE,
    "experiment_span": f"""
        SELECT client_id, experiment_id, {_text("start_time")} AS start_time, {_text("end_time")} AS end_time,
            CAST(floor((epoch(date_trunc('second', end_time)) - epoch(start_time)) / 3600) AS BIGINT) AS num_hour
        FROM span""",
    "ab_evaluation": """
        SELECT client_id, experiment_id, arms, CAST(sessions AS BIGINT) AS sessions,
            CAST(visitors AS BIGINT) AS visitors, best_variation_id, best_variation, round(best_rate, 6) AS best_rate,
            round(chi_square_sum, 6) AS chi_square_sum, round(confidence, 6) AS confidence,
            round(betterness, 6) AS betterness, CAST(required_sessions AS BIGINT) AS required_sessions
        FROM evaluation""",
    "experiment_summary": """
        SELECT client_id, experiment_id, status,
            CASE WHEN status <> 'insufficient' THEN best_variation_id END AS best_variation_id,
            CASE WHEN status <> 'insufficient' THEN best_variation END AS best_variation,
            CASE WHEN status <> 'insufficient' THEN round(betterness * 100, 2) END AS betterness_percentage,
            CASE WHEN status IN ('winner', 'no_clear_winner') AND confidence IS NOT NULL
                THEN confidence_percentage END AS confidence_percentage,
            CAST(CASE WHEN status = 'pending' THEN remaining END AS BIGINT) AS remaining_sessions,
            CAST(CASE WHEN status = 'pending' THEN floor(remaining
                / (CAST(sessions AS DOUBLE) / (num_hour + 1) * 24)) + 1 END AS BIGINT) AS remaining_days,
            CASE WHEN status IN ('insufficient', 'pending') THEN 'continue' ELSE 'stop' END AS recommendation
        FROM verdict""",
    "summary_text": """
        SELECT client_id, experiment_id,
            CASE WHEN status = 'insufficient' THEN 'Too few visitors so far.'
                ELSE concat(coalesce(best_variation, 'null'), ' leads by ',
                    coalesce(printf('%.2f', round(betterness * 100, 2)), 'null'), '%.') END AS summary,
            CASE status WHEN 'insufficient' THEN 'Too few visitors so far.'
                WHEN 'pending' THEN concat('About ', CAST(remaining AS BIGINT), ' more sessions are needed, some ',
                    CAST(floor(remaining / (CAST(sessions AS DOUBLE) / (num_hour + 1) * 24)) + 1 AS BIGINT), ' days.')
                WHEN 'winner' THEN concat(best_variation, ' wins with ', printf('%.2f', confidence_percentage),
                    '% confidence.')
                ELSE 'The sample is complete and no variation stands out.' END AS conclusion,
            CASE WHEN status IN ('insufficient', 'pending') THEN 'continue' ELSE 'stop' END AS recommendation
        FROM verdict""",
    "sticky_assignment": f"""
        SELECT client_id, experiment_id, session_id, variation_id, {_text("creation_time")} AS creation_time
        FROM ({_assigned("requests")}) WHERE variation_id IS NOT NULL""",
    "served_log": f"""
        SELECT {_EVENT_KEY}, {_text("creation_time")} AS creation_time
        FROM (SELECT *, 'served' AS event_name FROM ({_assigned("requests")})) WHERE variation_id IS NOT NULL""",
    "cookie_registration": f"""
        SELECT {_EVENT_KEY}, {_text("creation_time")} AS creation_time
        FROM (SELECT *, 'served' AS event_name FROM ({_assigned(
            "(SELECT client_id, session_id, min(creation_time) AS creation_time, 'e1' AS experiment_id"
            " FROM new_cookies GROUP BY ALL)")})) a
        WHERE NOT EXISTS (SELECT 1 FROM exp_events e WHERE e.client_id = a.client_id
            AND e.experiment_id = a.experiment_id AND e.session_id = a.session_id)""",
    "order_sessions": """
        SELECT o.client_id, o.order_id, o.cart_token, o.lines, count(c.session_id) AS sessions
        FROM (SELECT client_id, order_id, cart_token, count(*) AS lines FROM shop_orders
            WHERE payment_status GROUP BY ALL) o
        LEFT JOIN (SELECT DISTINCT client_id, cart_token, session_id FROM cookies) c USING (client_id, cart_token)
        GROUP BY ALL""",
    "order_totals": """
        SELECT client_id, order_id, session_id, CAST(total_order_value AS DOUBLE) AS total_order_value
        FROM order_total""",
    "visitor_orders": """
        SELECT client_id, session_id, device, browser, os, region, count(DISTINCT order_id) AS orders,
            CAST(count(*) // greatest(count(DISTINCT order_id), 1) AS BIGINT) AS rows,
            round(CAST(sum(total) / (count(*) // greatest(count(DISTINCT order_id), 1)) AS DOUBLE), 2) AS revenue
        FROM visit_orders GROUP BY client_id, session_id, device, browser, os, region""",
    "visitor_orders_null_sessions": """
        SELECT v.client_id, v.session_id, device, browser, os, region, count(DISTINCT order_id) AS orders,
            CAST(count(*) // greatest(count(DISTINCT order_id), 1) AS BIGINT) AS rows,
            round(CAST(sum(coalesce(total_order_value, 0)) / (count(*) // greatest(count(DISTINCT order_id), 1)) AS DOUBLE), 2)
                AS revenue
        FROM (SELECT * REPLACE (CASE WHEN device <> 'd0' THEN session_id END AS session_id) FROM visitors_w) v
        LEFT JOIN order_total_w t ON t.client_id = v.client_id AND t.session_id IS NOT DISTINCT FROM v.session_id
        GROUP BY v.client_id, v.session_id, device, browser, os, region""",
    "sales_by_dimension": _with_rates(
        " UNION ALL ".join(f"SELECT '{d}' AS dimension, * FROM ({_measures(d)})" for d in ("device", "browser", "os")),
        "client_id, dimension, value",
    ),
    "sales_by_region": _BY_REGION,
    "region_feature_collection": f"""
        SELECT client_id, 'FeatureCollection' AS document, type, id, region_name AS name,
            concat('{{"type":"Polygon","coordinates":[[[', id, ',0],[', CAST(id AS INTEGER) + 1, ',0],[', id, ',1],[', id, ',0]]]}}') AS geometry,
            session_count, visitor_count, sales_conversion_count, order_count, total_sales, sales_conversion, avg_order_value
        FROM ({_BY_REGION})""",
    "stream_visit_ingest": f"SELECT client_id, session_id, event_name, url, {_text('creation_time')} AS creation_time FROM visits",
    "stream_visitor_ingest": f"""
        SELECT client_id, session_id, device, browser, os, {_text("creation_time")} AS creation_time FROM visitors""",
    "stream_cookie_watermark": "SELECT client_id, session_id, cart_token FROM unique_cookies",
    "stream_anonymous_carts": f"""
        SELECT client_id, session_id, cart_token, {_text("creation_time")} AS creation_time, experiment_id, variation_id,
            'served' AS event_name, {_text("creation_time")} AS served_at
        FROM ({_assigned("(SELECT *, 'e1' AS experiment_id FROM anonymous)")}) JOIN
            (SELECT client_id, session_id, cart_token FROM anonymous) USING (client_id, session_id)""",
    "late_rows": f"""
        SELECT {_EVENT_KEY}, {_text("creation_time")} AS creation_time, k AS batch_id FROM ({_MARKED}) WHERE late""",
    "restated_days": f"""
        SELECT CAST(CAST(creation_time AS DATE) AS VARCHAR) AS day, client_id, experiment_id, variation_id, event_name,
            count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS late_events, count(*) AS restated
        FROM ({_MARKED}) GROUP BY ALL""",
    "stream_event_ingest": f"SELECT {_EVENT_KEY}, {_text('creation_time')} AS creation_time FROM exp_events",
    "stream_cookie_dedup": f"""
        SELECT client_id, session_id, cart_token, {_text("creation_time")} AS creation_time FROM unique_cookies""",
    "stream_order_upsert": f"SELECT {_ORDER_COLUMNS} FROM ({_UPSERT})",
    "stream_product_upsert": f"SELECT {_PRODUCT_COLUMNS} FROM ({_PRODUCT_UPSERT})",
    "stream_daily_counts": """
        SELECT CAST(CAST(creation_time AS DATE) AS VARCHAR) AS day, client_id, experiment_id, variation_id, event_name,
            count(*) AS events
        FROM exp_events GROUP BY ALL""",
    "stream_new_visitors": """
        SELECT CAST(CAST(creation_time AS DATE) AS VARCHAR) AS day, client_id, experiment_id, variation_id, event_name,
            count(DISTINCT session_id) AS visitors
        FROM exp_events GROUP BY ALL""",
    "stream_daily_visitors": _DAILY_VISITORS,
    "stream_daily_visitors_late": _DAILY_VISITORS,
}


def _with_views(body: str) -> str:
    """Prefix the SQL with the building blocks it uses, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed) + body


ORACLE = {name: _with_views(body) for name, body in BODIES.items()}
