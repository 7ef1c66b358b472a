"""Secrets by character Markov models: random strings against ordinary identifiers, by log-likelihood ratio."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import landed, let, text_or_empty
from shoplens.llm.spans import hits, located, overruled

# --- base kinds and candidates ---------------------------------------------------------------

ASSIGNED = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds by order in lists. A shorter match of a base kind than its least length is dropped; where a
#: dropped match could hide no other one, the pattern asks for the length itself.
PATTERNS = {
    "assign": ASSIGNED,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "random": r"[A-Za-z0-9+/_-]{16,}={0,2}",
}
BASE_KINDS = ("assign", "access", "hex")
ORDER = {kind: place for place, kind in enumerate(PATTERNS)}
LEAST_ASSIGNED = 8

# --- labelled samples ------------------------------------------------------------------------

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1  # and the start, 0
#: Random strings made from hashes, in each of four alphabets, beside those that the base kinds find.
MADE = 4_000
MADE_CHARS = 40
#: What ordinary identifiers look like: words in one case, joined capitalised words and numbers, between marks.
ORDINARY = r"^[+/_=-]*+(?:(?:[A-Z]?[a-z]{2,}+(?:[A-Z][a-z]{2,}+)*+|[A-Z]{2,}+|[0-9]++)(?:[+/_=-]++|$))++$"
#: Longer strings carry no label; they are scored as all others are.
LABEL_CHARS = 128
SMOOTHING = 0.5
#: Scores are thousandths of a natural logarithm. A random string must be a thousand times likelier, and more
#: if over one in a thousand of the ordinary strings held out would still pass.
LEAST_ODDS = 6_908
FALSE_SHARE = 0.001
_STEP = 1_000


@dataclass(frozen=True)
class Model:
    """How much each pair of following characters speaks for a random string, and the score that decides."""

    weights: tuple[int, ...]  # by previous character * STATES + character
    threshold: int

    def score(self, hit: Column) -> Column:
        """Log-likelihood ratio of a string of the alphabet, as one column expression."""
        weights = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")

        def follow(state: Column, char: Column) -> Column:
            place = F.instr(F.lit(ALPHABET), char)
            step = F.get(weights, state["at"] * STATES + place).cast("long")
            return F.struct(place.alias("at"), (state["sum"] + step).alias("sum"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(_chars(hit), start, follow, lambda state: state["sum"])


def _chars(hit: Column) -> Column:
    return F.filter(F.split(hit, ""), lambda c: c != "")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' other columns with a row number, and one row per match of a kind.

    One scan of the whole texts; what is landed are the few matches, not the texts.
    """
    text = text_or_empty("text")
    found = [F.struct(F.lit(kind).alias("kind"), hits(text, pattern).alias("hits")) for kind, pattern in PATTERNS.items()]
    carry = [name for name in docs.columns if name != "text"]
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"),
        F.filter(F.array(*found), lambda f: F.size(f["hits"]) > 0).alias("found"),
    )
    base = landed(base, "secret-hits")
    each = base.select("_row", F.explode("found").alias("f")).select("_row", "f.kind", "f.hits")
    value = F.regexp_extract("hit", ASSIGNED, 1)
    long_enough = (F.col("kind") != "assign") | (F.length(value) >= LEAST_ASSIGNED)
    spans = located(each, ["_row", "kind"], "hits").filter(long_enough)
    return base.select("_row", "row"), spans.select("_row", "kind", "start", "end", "hit")


def made_strings(spark: SparkSession, n: int = MADE) -> DataFrame:
    """``hit``: n strings each of lower and upper hexadecimal, base 64 and its variant for addresses."""
    digest = lambda name: F.sha2(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.base64(F.unhex(digest("base64")))
    forms = [
        digest("hex"),
        F.upper(digest("upper")),
        coded,
        F.translate(F.base64(F.unhex(digest("address"))), "+/", "-_"),
    ]
    return spark.range(n).select(F.explode(F.array(*[F.left(form, F.lit(MADE_CHARS)) for form in forms])).alias("hit"))


def labelled(spans: DataFrame) -> DataFrame:
    """Distinct (``hit``, ``random``): the samples that the models are trained from.

    Random are the made strings and the candidates that touch a span of a base kind and look like no
    ordinary identifier; ordinary are the other candidates of that look. All others, and strings of
    over ``LABEL_CHARS`` characters, stay without a label.
    """
    shape = F.col("hit").rlike(ORDINARY)
    spans = spans.filter((F.col("kind") != "random") | (F.length("hit") <= LABEL_CHARS))
    both = overruled(spans.withColumn("level", F.when(F.col("kind") == "random", -1).otherwise(0)), "_row", [0, -1], "kind")
    own = both.filter((F.col("kind") == "random") & (F.col("overruled") != shape))
    own = own.select("hit", F.col("overruled").alias("random")).distinct()
    return own.unionByName(made_strings(spans.sparkSession).withColumn("random", F.lit(True)))


def trained(samples: DataFrame) -> Model:
    """Both models from the labelled strings, and the threshold from the ordinary ones that were held out.

    Every fifth string, by its MD5, is held out. The driver gets one count per class and pair of
    characters, and one per step of the scores.
    """
    rows = samples.withColumn("held", F.conv(F.substring(F.md5(F.col("hit").cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0)
    rows = landed(rows, "secret-samples")
    chars = rows.filter("not held").select("random", F.transform(_chars(F.col("hit")), lambda c: F.instr(F.lit(ALPHABET), c)).alias("c"))
    pairs = chars.select(
        "random", F.explode(F.transform("c", lambda c, i: F.when(i == 0, 0).otherwise(F.get("c", i - 1)) * STATES + c)).alias("pair")
    )
    counts = {True: [0] * STATES**2, False: [0] * STATES**2}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row.random][row.pair] = row["count"]
    chance = {}
    for label, own in counts.items():
        sums = [sum(own[at : at + STATES]) for at in range(0, STATES**2, STATES)]
        chance[label] = [(n + SMOOTHING) / (sums[at // STATES] + SMOOTHING * STATES) for at, n in enumerate(own)]
    weights = tuple(round(1000 * log(chance[True][at] / chance[False][at])) for at in range(STATES**2))
    model = Model(weights, LEAST_ODDS)
    steps = rows.filter("held and not random").groupBy(F.floor(model.score(F.col("hit")) / _STEP).alias("step"))
    high = sorted(((row.step, row["count"]) for row in steps.count().collect()), reverse=True)
    allowed = FALSE_SHARE * sum(n for _, n in high)
    threshold, passed = LEAST_ODDS, 0
    for step, n in high:
        passed += n
        if passed > allowed:
            threshold = max(threshold, (step + 1) * _STEP)
            break
    return Model(weights, threshold)


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (``_row``, ``row``) and the secrets (``_row``, kind, start, end, hit, score).

    Base kinds always stay. Of the other runs of 16 or more identifier characters those are added, as
    ``random``, whose log-likelihood ratio reaches the model's threshold and that no base span
    overlaps. The models come from all candidates of all documents that carry a label.
    Null and empty texts have no spans; repeated rows each have their own; no documents, no spans.
    """
    rows, spans = candidates(docs)
    spans = landed(spans, "secret-spans")
    model = trained(labelled(spans))
    score = F.when(F.col("kind") == "random", model.score(F.col("hit")))
    found = spans.withColumn("score", score).filter((F.col("kind") != "random") | (F.col("score") >= model.threshold))
    ranked = found.withColumn("level", F.when(F.col("kind") == "random", -1).otherwise(0))
    kept = overruled(ranked, "_row", [0, -1], "kind").filter((F.col("kind") != "random") | ~F.col("overruled"))
    return rows, kept.select("_row", "kind", "start", "end", "hit", "score")


def listed(spans: DataFrame) -> DataFrame:
    """Per document with spans: counts by kind, and base and all spans as ``kind:start:end`` lists."""
    rank = F.create_map(*[x for name, place in ORDER.items() for x in (F.lit(name), F.lit(place))])
    entry = F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind")

    def joined(entries: Column) -> Column:
        text = lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))
        return let(F.sort_array(entries), lambda own: F.array_join(F.transform(own, text), ","))

    counts = [F.count_if(F.col("kind") == name).alias(f"n_{name}") for name in PATTERNS]
    return spans.groupBy("_row").agg(
        *counts,
        joined(F.collect_list(F.when(F.col("kind") != "random", entry))).alias("base_spans"),
        joined(F.collect_list(entry)).alias("spans"),
    )


def secrets_of(docs: DataFrame) -> DataFrame:
    """``row`` (the documents' columns but the text), ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_spans``, ``spans``."""
    rows, spans = spans_of(docs)
    out = rows.join(listed(spans), "_row", "left")
    return out.select(
        "row",
        *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in PATTERNS],
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("base_spans", "spans")],
    )
