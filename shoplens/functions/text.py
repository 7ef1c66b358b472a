"""Text rules for urls, landing pages and product tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TAG = "no-tag"
_BLANKS = " \t\n\r\f\v"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def last_path_segment(url: Column) -> Column:
    """The part after the last slash; a query string stays in it."""
    return _strip(F.substring_index(url, "/", -1))


def page_type(landing_page: Column) -> Column:
    """Class of a landing page; the first match wins and a missing page counts as home."""
    return (
        F.when(landing_page.contains("product") | landing_page.contains("checkout"), "product")
        .when(landing_page.contains("collection"), "collection")
        .otherwise("home")
    )


def tag_list(tags: Column) -> Column:
    """Distinct trimmed tags of a comma list, or the no-tag marker for an empty one."""
    parts = F.array_distinct(F.transform(F.split(tags, ","), _strip))
    return F.when(F.coalesce(F.length(tags), F.lit(0)) == 0, F.array(F.lit(NO_TAG))).otherwise(parts)


def filled(text: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(F.length(text), F.lit(0)) > 0
