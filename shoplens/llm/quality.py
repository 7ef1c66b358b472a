"""Quality rules: text statistics and a decision list learned from labelled documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import GAP, landed, let, text_or_empty, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates that conditions are made of, besides the number of words.
RATES = ("word_length", "symbol_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate", "line_words")
FEATURES = ("n_words", *RATES)
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_COVERED = 5
MIN_PRECISION = 0.95


def _repeat_words(tokens: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included."""

    def repeated(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def covered(order: Column) -> Column:
            twice = F.filter(
                order,
                lambda x, i: (x["h"] == F.get(order, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(order, i - 1)["h"])),
            )
            starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(
                starts,
                zero,
                lambda a, s: F.struct(
                    (s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n")
                ),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, covered)).otherwise(0)

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - WINDOW), lambda i: F.xxhash64(*[tokens[i + k] for k in range(WINDOW)])
    )
    return F.when(F.size(tokens) >= WINDOW, let(hashed, repeated)).otherwise(0)


def _kept_length(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, ""))


def measured(docs: DataFrame, *carry: str | Column) -> DataFrame:
    """``carry`` and the statistics of each text, one scan and no shuffle.

    Null and empty texts count 0 throughout; a rate over nothing is 0. Windows are compared by a
    64-bit hash, lines as they are (a line without a word never counts).
    """
    text = text_or_empty("text")

    def lines_of(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")
        )

    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *carry,
        let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        let(worded, lines_of).alias("_l"),
        _kept_length(text, GAP).alias("word_chars"),
        _kept_length(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _kept_length(text, "[^A-Z]+").alias("_upper"),
        _kept_length(text, "[^0-9]+").alias("_digits"),
    )
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("_w.n_words", "word_chars", "_l.n_lines"))
    rates = {
        "word_length": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "upper_rate": F.col("_upper") / chars,
        "digit_rate": F.col("_digits") / chars,
        "dup_line_rate": F.col("_l.n_dup_lines") / lines,
        "repeat_rate": F.col("_w.n_repeat_words") / n,
        "line_words": F.col("_w.n_words") / lines,
    }
    places = {"n_words": "_w.n_words", "n_repeat_words": "_w.n_repeat_words", "n_dup_lines": "_l.n_dup_lines"}
    kept = [name if isinstance(name, str) else counted.columns[i] for i, name in enumerate(carry)]
    return counted.select(
        *kept,
        *[F.col(places.get(name, name)).cast("long").alias(name) for name in BASE],
        *[rates[name].alias(name) for name in RATES],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


@dataclass(frozen=True)
class Condition:
    """``feature`` at most ``limit``, or above it."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > self.limit if self.above else F.col(self.feature) <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (condition.column() for condition in rule), F.lit(True))


def _verdicts(rules: list[Rule]) -> Column:
    """The text of the first rule that holds; null where none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(_holds(rule), " and ".join(map(str, rule))).otherwise(verdict)
    return verdict


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(cut)) for cut in cuts]), lambda cut: value > cut))


def _purity_gain(covered: tuple[int, int], now: tuple[int, int]) -> float:
    """Gain in information per rejected document, times the rejected documents that stay covered."""
    from math import log2

    if not covered[0]:
        return 0.0
    return covered[0] * (log2(covered[0] / sum(covered)) - log2(now[0] / sum(now)))


class Learner:
    """Sequential covering from counts that Spark makes; only bin counts reach the driver.

    Two thirds of the labelled rows (by a hash of the id) grow rules, one third prunes them. A rule
    starts empty and takes the threshold condition with the largest gain, until it covers no good
    document or nothing gains. It is then cut back to the prefix that is purest on the other third,
    and accepted if there it covers ``MIN_COVERED`` documents with ``MIN_PRECISION``. Rules that
    reject only what earlier ones left over follow, up to ``MAX_RULES``.
    """

    def __init__(self, labelled: DataFrame):
        quantiles = [k / BINS for k in range(1, BINS)]
        row = labelled.agg(*[F.percentile_approx(name, quantiles, 1000).alias(name) for name in FEATURES]).first()
        self.cuts = {name: sorted(set(row[name] or [])) for name in FEATURES}
        self.rows = labelled

    def _counts(self, rules: list[Rule], grown: Rule) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good growing rows by feature and bin, under the grown rule and past the earlier ones."""
        open_rows = self.rows.filter("grows").filter(_verdicts(rules).isNull()).filter(_holds(grown))
        bins = [
            F.struct(F.lit(name).alias("feature"), _bin(F.col(name), cuts).alias("bin"))
            for name, cuts in self.cuts.items()
        ]
        found = open_rows.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin")
        found = found.agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()
        return {(row.feature, row.bin): (row.bad, row.n - row.bad) for row in found}

    def _best(self, counts: dict[tuple[str, int], tuple[int, int]]) -> tuple[float, Condition | None, tuple[int, int]]:
        best: tuple[float, Condition | None, tuple[int, int]] = (0.0, None, (0, 0))
        for name, cuts in self.cuts.items():
            each = [counts.get((name, b), (0, 0)) for b in range(len(cuts) + 1)]
            now = (sum(b for b, _ in each), sum(g for _, g in each))
            if not now[0]:
                return best
            for i, cut in enumerate(cuts):
                low = (sum(b for b, _ in each[: i + 1]), sum(g for _, g in each[: i + 1]))
                for above, covered in ((False, low), (True, (now[0] - low[0], now[1] - low[1]))):
                    gain = _purity_gain(covered, now)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, float(cut)), covered)
        return best

    def _centred(self, rules: list[Rule], grown: Rule, condition: Condition) -> Condition:
        """The same split with its limit half-way between the values on either side."""
        value, limit = F.col(condition.feature), F.lit(condition.limit)
        open_rows = self.rows.filter("grows").filter(_verdicts(rules).isNull()).filter(_holds(grown))
        row = open_rows.agg(F.max(F.when(value <= limit, value)), F.min(F.when(value > limit, value))).first()
        if None in tuple(row):
            return condition
        return Condition(condition.feature, condition.above, (float(row[0]) + float(row[1])) / 2)

    def _grow(self, rules: list[Rule]) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            _, condition, covered = self._best(self._counts(rules, rule))
            if condition is None:
                break
            rule = (*rule, self._centred(rules, rule, condition))
            if not covered[1]:
                break
        return rule

    def _prune(self, rules: list[Rule], rule: Rule) -> Rule:
        held_out = self.rows.filter("not grows").filter(_verdicts(rules).isNull())
        sums = []
        for k in range(1, len(rule) + 1):
            held = _holds(rule[:k])
            sums += [F.count_if(held & F.col("bad")).alias(f"bad{k}"), F.count_if(held).alias(f"n{k}")]
        row = held_out.agg(*sums).first()
        value = lambda k: (row[f"bad{k}"] + 1) / (row[f"n{k}"] + 2)
        best = max(range(1, len(rule) + 1), key=lambda k: (value(k), -k))
        sure = row[f"bad{best}"] >= MIN_COVERED and row[f"bad{best}"] >= MIN_PRECISION * row[f"n{best}"]
        return rule[:best] if sure else ()

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        while len(rules) < MAX_RULES:
            rule = self._grow(rules)
            rule = self._prune(rules, rule) if rule else ()
            if not rule:
                break
            rules.append(rule)
        return rules


def learn(measures: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list that rejects documents labelled with quality 0.

    Labels without a document, and null labels, are left out; a document with several labels is an
    example for each. Documents that the base rule rejects need no further rule and are left out.
    No labelled rows, no rules.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), "quality").filter("quality is not null")
    rows = measures.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("_id"))
    grows = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    rows = rows.select(*FEATURES, (F.col("quality") == 0).alias("bad"), grows.alias("grows"))
    return Learner(landed(rows, "quality-labelled")).learn()


def judged(docs: DataFrame, labels: DataFrame, *carry: str | Column) -> DataFrame:
    """``carry``, the statistics, ``base_failed``, ``rule`` (that rejects it, if any) and ``kept`` of each document.

    ``carry`` must hold ``doc_id`` or keep it as a column of that name. Repeated rows are judged alike.
    """
    measures = landed(measured(docs, *carry), "quality-measures")
    judged_rows = measures.withColumn("base_failed", base_failed()).withColumn("rule", _verdicts(learn(measures, labels)))
    return judged_rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
