"""License scans: keyword-gated signature rules with priorities and containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed, let, lower_ascii, text_or_empty
from shoplens.llm.license_rules import GATES, SPLIT_GATES, rules
from shoplens.llm.spans import hits, located, overruled

_SEPARATOR = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_GAP = f"[{_SEPARATOR}]+"
#: Words of the raw text: the same runs as in the lower-cased one, which A-Z belong to as well.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The phrases of the base scan and their labels.
BASE_PHRASES = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)
PLACES = "array<struct<label:string,at:int>>"
RULE_HITS = "array<struct<rule:int,hits:array<struct<gap:int,hit:string,left:string,right:string>>>>"


def _java(pattern: str) -> str:
    """The pattern with its spaces standing for separators, between word borders."""
    spaced = pattern.replace(" ?", f"[{_SEPARATOR}]*").replace(" ", _GAP)
    return f"(?<![^{_SEPARATOR}])(?:{spaced})(?![^{_SEPARATOR}])"


def _keyword(keyword: str) -> str:
    return "".join(c if c.isalnum() else " " for c in keyword)


RULES = [(priority, label, _keyword(keyword), _java(pattern)) for priority, label, keyword, pattern in rules()]
LEVELS = sorted({priority for priority, *_ in RULES})


def _gate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(word) for word in GATES]) | low.rlike(
        "|".join(SPLIT_GATES).replace(" ", _GAP)
    )


def _base_places(words: Column) -> Column:
    """Where the words of a base phrase stand one after another."""

    def phrase(parts: tuple[str, ...], label: str) -> Column:
        def starts(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.get(words, i + k) == part for k, part in enumerate(parts)])

        first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        return F.transform(F.filter(first, starts), lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))

    return F.flatten(F.array(*[phrase(parts, label) for parts, label in BASE_PHRASES]))


def _rule_hits(low: Column) -> Column:
    """The hits of every rule whose keyword the text has."""
    table = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"))
            for i, (_, _, keyword, pattern) in enumerate(RULES)
        ]
    )

    def tried(normal: Column) -> Column:
        known = F.filter(table, lambda r: normal.contains(r["keyword"]))
        each = F.transform(known, lambda r: F.struct(r["rule"].alias("rule"), hits(low, r["pattern"]).alias("hits")))
        return F.filter(each, lambda r: F.size(r["hits"]) > 0)

    return let(F.regexp_replace(low, _GAP, " "), tried)


def scanned(docs: DataFrame) -> DataFrame:
    """Per document ``_row``, ``row`` (other columns), ``n_words``, ``base`` places and ``found`` rule hits; landed."""
    text = text_or_empty("text")
    carry = [name for name in docs.columns if name != "text"]
    low = lower_ascii(text)
    inside = let(
        low,
        lambda t: F.struct(
            let(F.filter(F.split(t, _GAP), lambda w: w != ""), _base_places).cast(PLACES).alias("base"),
            _rule_hits(t).cast(RULE_HITS).alias("found"),
        ),
    )
    empty = F.struct(F.array().cast(PLACES).alias("base"), F.array().cast(RULE_HITS).alias("found"))
    return landed(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"),
            F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
            F.when(_gate(text), inside).otherwise(empty).alias("_s"),
        ).select("_row", "row", "n_words", "_s.base", "_s.found"),
        "license-hits",
    )


def detections(scan: DataFrame) -> DataFrame:
    """Rows of ``_row``, label, priority, start, end (code points) that no other detection overrules.

    A detection gives way to any overlapping one of higher priority, and to one of the same
    priority that it lies inside; of equal intervals the rule listed first stays.
    """
    each = scan.select("_row", F.explode("found").alias("f")).select("_row", "f.rule", "f.hits")
    spans = located(each, ["_row", "rule"], "hits").select("_row", "rule", "start", "end")
    by_rule = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(label).alias("l")) for p, label, *_ in RULES])
    spans = spans.withColumn("_r", by_rule[F.col("rule")])
    ranked = overruled(spans.withColumn("level", F.col("_r.p")), "_row", LEVELS, "rule")
    return ranked.filter(~F.col("overruled")).select(
        "_row", F.col("_r.l").alias("label"), F.col("level").alias("priority"), "start", "end"
    )


def licensed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text) with the base scan, all ``labels``, their ``spans`` and a ``score``.

    The score is the highest priority of a detection as a share of 100, at least 0.6 with a base
    phrase and 0 without any. Null and empty texts have no words; repeated rows are scanned each.
    Nothing is shuffled but the detections and the narrow rows they belong to.
    """
    scan = scanned(docs)
    span = F.struct("start", "end", "label", "priority")
    found = detections(scan).groupBy("_row").agg(
        F.collect_set("label").alias("_labels"),
        F.max("priority").alias("_top"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    base = F.transform("base", lambda b: b["label"])
    at = F.transform("base", lambda b: b["at"].cast("long"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan.join(found, "_row", "left").select(
        "row",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce(F.col("_top") / 100, F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int>>")).alias("spans"),
    )
