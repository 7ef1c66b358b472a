"""A small shop of our own making for the report tests."""

import datetime as dt

CLIENT = "shop"
OPENED = dt.datetime(2020, 6, 1, 8, 0, tzinfo=dt.timezone.utc)

# How many sessions enter on a page, and how many of them go on to each later one.
JOURNEYS = {
    "home": {"collection": 18, "product": 12, "cart": 9},
    "collection": {"product": 3},
    "product": {"cart": 2},
}
ENTRIES = {"home": 24, "collection": 6, "product": 4}
URLS = {"home": "/", "collection": "/collections/new", "cart": "/cart"}


def visit_rows():
    """One session after the other; every third product page is that of the same product."""
    rows = []
    for entry, sessions in ENTRIES.items():
        for n in range(sessions):
            path = [entry, *[page for page, reached in JOURNEYS[entry].items() if n < reached]]
            for page in path:
                rows.append(
                    {
                        "client_id": CLIENT,
                        "session_id": f"{entry}-{n}",
                        "event_name": page,
                        "creation_time": (OPENED + dt.timedelta(minutes=len(rows))).isoformat(),
                        "url": URLS.get(page, f"/products/handle_{n % 3 + 1}"),
                    }
                )
    return rows


# variant: (product, price)
VARIANTS = {11: (1, "12.50"), 12: (1, "11.00"), 21: (2, "6.75"), 22: (2, "7.25"), 31: (3, "80.00"), 41: (4, "33.00")}
TAGS = {1: "wool, sale", 2: "sale", 3: "wool", 4: ""}


def _document(key, email, landing, minute, lines):
    return {
        "id": key,
        "email": email,
        "cart_token": f"cart_{key}",
        "updated_at": (OPENED + dt.timedelta(days=2, minutes=minute)).isoformat(),
        "landing_site": landing,
        "line_items": [
            {"variant_id": v, "quantity": n, "product_id": VARIANTS[v][0], "price": VARIANTS[v][1]} for v, n in lines
        ],
    }


def order_page():
    """Five paid orders of two lines each, from three customers."""
    return [
        _document(1, "ann", "/", 0, [(11, 1), (22, 3)]),
        _document(2, "bob", "/collections/sale", 3, [(12, 2), (31, 1)]),
        _document(3, "cy", "/", 5, [(21, 1), (41, 2)]),
        _document(4, "ann", "/products/handle_2", 8, [(22, 1), (31, 2)]),
        _document(5, "bob", "/", 9, [(11, 4), (41, 1)]),
    ]


def checkout_page():
    """Two open checkouts of two lines each."""
    return [
        _document(21, "dee", "/", 11, [(21, 2), (12, 1)]),
        _document(22, "bob", "/products/handle_3", 14, [(31, 1), (11, 1)]),
    ]


def product_page():
    """The four products of the variants above."""
    changed = (OPENED + dt.timedelta(hours=1)).isoformat()
    return [
        {
            "id": product,
            "title": f"title_{product}",
            "handle": f"handle_{product}",
            "updated_at": changed,
            "tags": tags,
            "variants": [
                {"id": v, "title": f"variant_{v}", "price": price, "updated_at": changed}
                for v, (of, price) in VARIANTS.items()
                if of == product
            ],
        }
        for product, tags in TAGS.items()
    ]


def pages(spark, feed, entries, client=CLIENT):
    """A landed page as parsed rows (client_id, entries)."""
    import json

    from shoplens.sources.documents import parse_pages

    body = json.dumps({feed: entries})
    return parse_pages(spark.createDataFrame([(client, body)], "client_id string, body string"), feed)
