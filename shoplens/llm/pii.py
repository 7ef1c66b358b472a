"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier is trained."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed, let, text_or_empty
from shoplens.llm.spans import NO_HITS, hits, located, overruled

# --- candidates ------------------------------------------------------------------------------

_LOCAL = "A-Za-z0-9._%+-"

# Country codes and lengths of account numbers under ISO 13616.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}
# Common generic and country endings of host names.
ENDINGS = (
    "com org net edu gov mil int info biz name io ai app dev me tv co eu ac ae ar at au be bg br by ca ch cl cn cz de dk "
    "ee es fi fr gr hk hr hu id ie il in ir is it jp ke kr kz lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se "
    "sg si sk th tr tw ua uk us uy ve vn za"
).split()
# Common given names of the texts' languages.
GIVEN_NAMES = (
    "adam alan albert alejandro alex alexander alice amanda amy ana andrea andreas andrew angela anna anne anthony antonio "
    "barbara benjamin bernd birgit brian camille carla carlos carmen carol caroline charles charlotte christian christine "
    "christopher claire claudia daniel david deborah diego dominique donald edward elena elizabeth emily emma eric eva "
    "fernando francisco frank franz friedrich gabriel george gerard hans heather heike heinz helen helena henry isabel jack "
    "jacques james jan jane javier jean jennifer jessica joan john jonathan jorge jose joseph juan julia julie karen karl "
    "katharina kevin klaus laura lena linda lisa louis lucas lucia luis luisa marc marco margaret maria marie mark markus "
    "martin martina mary matthew max michael michel miguel monica monika nancy nathalie nicolas nicole olivier pablo patricia "
    "patrick paul pedro peter petra philippe pierre rachel rafael richard robert rosa ruth sabine samuel sandra sara sarah "
    "scott sebastian sofia sophie stefan stephen steven susan susanne sylvie teresa thomas timothy ursula uwe victor "
    "walter werner william wolfgang yves"
).split()


def _sized_ibans() -> str:
    """Account numbers of the length that their country has, with or without spaces."""
    forms = [f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
    return f"^(?:{'|'.join(forms)})$"


@dataclass(frozen=True)
class Kind:
    """A sort of span: where candidates are, what they must contain, and what speaks for and against them."""

    name: str
    pattern: str
    gate: str  # a text without a match of this has no candidate
    strict: str  # regex labeler: the usual full form
    known: str  # gazetteer labeler: listed prefixes, endings or names
    cues: str  # context labeler: words before the span
    base: bool = False


# The patterns of the base kinds match what their contract's patterns match, written without
# repeated groups (which overflow the stack on long texts) and without rescanning long runs.
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?"
        r"(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)",
        "@",
        r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}$",
        rf"(?i)\.(?:{'|'.join(ENDINGS)})$",
        r"(?i)(?:e-?mail|mail|contact|write|reach|kontakt|contacto|courriel|correo)",
        True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        r"^(?!(?:10|127|169\.254|192\.168)\.)(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
        r"(?i)(?:\bip\b|address|host|server|from|adresse|direcci)",
        True,
    ),
    Kind(
        "card",
        r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?=[ -]?(?:[^0-9 -]|\z)|[ -][ -])",
        r"[0-9][ -]?[0-9]",
        r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^3[47][0-9]{13}$",
        r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[689]|35(?:2[89]|[3-8])|6011|62|64[4-9]|65|67)",
        r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"\+[0-9]",
        r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
        r"^\+(?:1|7|2[07]|2(?:1[1-368]|[2346][0-9]|5[0-8]|9[0-9])|3[0-469]|3(?:5[0-9]|7[0-8]|8[0-9])|4[013-9]|42[0-3]|5[1-8]|"
        r"5[09][0-9]|6[0-6]|6(?:7[02-9]|8[0-9]|9[0-2])|8[1246]|8(?:5[02356]|8[06])|9[0-58]|9(?:6[0-8]|7[0-7]|9[2-8]))",
        r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|anruf|appel|llam)",
        True,
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
        r"[0-9]{3}[-. ][0-9]{4}",
        r"^\([2-9][0-9]{2}\) ?[2-9][0-9]{2}-[0-9]{4}$|^[2-9][0-9]{2}([-.])[2-9][0-9]{2}\1[0-9]{4}$",
        r"^\(?(?!37|96|[2-9]11|[2-9]9)[2-9][0-9]{2}[-. )]+(?!11)[2-9]",
        r"(?i)(?:phone|tel|call|mobile|fax|cell|number|nummer)",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]-[0-9]{2}-[0-9]",
        r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
        r"^(?!000|666|9|078-05-1120|219-09-9999)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
        r"(?i)(?:ssn|social|security|insurance|taxpayer)",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}",
        _sized_ibans(),
        rf"^(?:{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})",
        r"(?i)(?:iban|konto|account|bank|compte|cuenta)",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|"
        r"(?i:password|passwd|pwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9!$%&*+/_.-]{8,128})",
        r"AKIA|gh[pousr]_|(?i:password|passwd|pwd|token|secret|api[_-]?key) ?[=:]",
        r"^AKIA[0-9A-Z]{16}$|^gh[pousr]_|[=:] ?[\"']?(?=[^0-9]*[0-9])(?=[^a-zA-Z]*[a-zA-Z])[A-Za-z0-9!$%&*+/_.-]{12,}$",
        r"^(?:AKIA|gh[pousr]_)|[=:] ?[\"']?(?:[sr]k_(?:live|test)_|xox[abprs]-|AIza|glpat-|eyJ|[0-9a-f]{32,}$)",
        r"(?i)(?:key|secret|credential|login|access|aws|auth)",
    ),
    Kind(
        "person",
        r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.? [A-Z][a-zà-ÿ]{1,20}(?: [A-Z][a-zà-ÿ]{1,20})?",
        r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.? [A-Z]",
        r"^(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+ [A-Z][a-z]+$",
        rf"(?i) (?:{'|'.join(GIVEN_NAMES)})\b",
        r"(?i)(?:dear|signed|name|regards|from|hello|sehr geehrte|cher|estimad)",
    ),
    Kind(
        "account",
        r"(?<![0-9A-Za-z.])[0-9]{8,20}(?![0-9A-Za-z])",
        r"[0-9]{8}",
        r"^[0-9]{10,12}$",
        r"^(?![12][09][0-9]{2}(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])$)[1-9]",
        r"(?i)(?:account|acct|customer|passport|licen[cs]e|konto|compte|cuenta)",
    ),
)
BASE_KINDS = tuple(kind.name for kind in KINDS if kind.base)
ORDER = {kind.name: place for place, kind in enumerate(KINDS)}
#: Context that speaks against a span, for all kinds.
COUNTER_CUES = r"(?i)(?:version|v\.|isbn|page|fig\.|figure|chapter|section|no\.|§|[$€£]|ticket|commit|sha)\s*$"
LABELERS = ("format", "gazetteer", "cue", "counter", "border", "valid")
FLAGS = ("letters", "upper", "digits8", "digits12", "marks", "spaced", "long", "ends")
#: Expectation-maximisation ends when no belief moves by more, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 5_000
SMOOTHING = 1.0
THRESHOLD = 0.5


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _luhn(hit: Column) -> Column:
    """Of 12 to 19 digits; other lengths are not looked at."""

    def total(numbers: Column) -> Column:
        def add(sum_: Column, place: Column) -> Column:
            digit = F.get(numbers, F.size(numbers) - 1 - place).cast("int")
            twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
            return sum_ + F.when(place % 2 == 1, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(0), F.size(numbers) - 1), F.lit(0), add)

    numbers = F.filter(F.split(_digits(hit), ""), lambda d: d != "")
    proper = F.length(_digits(hit)).between(12, 19)
    return proper & F.when(proper, let(numbers, total) % 10 == 0).otherwise(False)


def _small_parts(hit: Column) -> Column:
    short = F.split(F.regexp_replace(hit, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
    return F.forall(short, lambda part: (F.length(part) <= 3) & (F.left(part, F.lit(3)).cast("int") <= 255))


def _mod_97(hit: Column) -> Column:
    """Whether the check digits of an account number under ISO 13616 are right."""
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(signs, F.lit(0), add) == 1


def _valid() -> Column:
    """What the base kinds demand of a match, check digits of account numbers; else that the digits are not all one."""
    hit = F.col("hit")
    return (
        F.when(F.col("kind") == "ip", _small_parts(hit))
        .when(F.col("kind") == "card", _luhn(hit))
        .when(F.col("kind") == "phone", F.length(_digits(hit)).between(9, 15))
        .when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "iban", _mod_97(hit))
        .otherwise(~_digits(hit).rlike(r"^([0-9])\1{5,}$"))
    )


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' other columns with a row number, and one row per candidate span with its context.

    One scan of the texts; what is landed are the few matches, not the texts.
    """
    text = text_or_empty("text")
    found = [
        F.struct(
            F.lit(kind.name).alias("kind"),
            F.when(text.rlike(kind.gate), hits(text, kind.pattern)).otherwise(F.array().cast(NO_HITS)).alias("hits"),
        )
        for kind in KINDS
    ]
    carry = [name for name in docs.columns if name != "text"]
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"),
        F.filter(F.array(*found), lambda f: F.size(f["hits"]) > 0).alias("found"),
    )
    base = landed(base, "pii-hits")
    each = base.select("_row", F.explode("found").alias("f")).select("_row", "f.kind", "f.hits")
    return base.select("_row", "row"), located(each, ["_row", "kind"], "hits").withColumn("valid", _valid())


# --- votes and features ----------------------------------------------------------------------


def _by_kind(column: Column, pattern: str) -> Column:
    """Whether ``column`` matches the pattern named so of the row's kind."""
    out = F.lit(False)
    for kind in KINDS:
        out = F.when(F.col("kind") == kind.name, column.rlike(getattr(kind, pattern))).otherwise(out)
    return out


def voted(spans: DataFrame) -> DataFrame:
    """One vote per labeler: 1 for personal data, -1 against, 0 abstains."""
    hit, left, right = F.col("hit"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))
    free = left.rlike(r"(?:^|[\s\p{Punct}])$") & right.rlike(r"^(?:$|[\s\p{Punct}])")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never, always = F.lit(False), F.lit(True)
    votes = {
        "format": vote(_by_kind(hit, "strict"), always),
        "gazetteer": vote(_by_kind(hit, "known"), never),
        "cue": vote(_by_kind(left, "cues"), never),
        "counter": vote(never, left.rlike(COUNTER_CUES)),
        "border": vote(free, always),
        "valid": vote(F.col("valid"), always),
    }
    n_digits = F.length(_digits(hit))
    flags = {
        "letters": hit.rlike("[A-Za-z]"),
        "upper": hit.rlike("[A-Z]"),
        "digits8": n_digits >= 8,
        "digits12": n_digits >= 12,
        "marks": hit.rlike(r"[^A-Za-z0-9 ]"),
        "spaced": hit.contains(" "),
        "long": F.length(hit) > 20,
        "ends": right.rlike(r"^(?:$|[.,;\n])"),
    }
    return spans.withColumns({f"v_{name}": votes[name] for name in LABELERS}).withColumns(
        {f"x_{name}": flags[name].cast("int") for name in FLAGS}
    )


# --- estimation ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cell:
    """How many spans share a kind, votes and flags."""

    kind: str
    votes: tuple[int, ...]
    flags: tuple[int, ...]
    n: int


def posteriors(cells: list[Cell]) -> list[float]:
    """Probability of personal data in each cell: expectation-maximisation over labeler reliabilities.

    Each labeler has a chance of each vote for either truth, each kind a prior; votes are
    independent given the truth. Starts from the balance of votes beyond the two that nearly every
    candidate has: a free border and digits that are not all one.
    """
    belief = [1 / (1 + exp(2 - sum(cell.votes))) for cell in cells]
    moved = 1.0
    for _ in range(ROUNDS):
        if moved <= TOLERANCE:
            break
        chance = []
        for j in range(len(LABELERS)):
            table = {(truth, vote): SMOOTHING for truth in (0, 1) for vote in (-1, 0, 1)}
            for cell, p in zip(cells, belief, strict=True):
                table[1, cell.votes[j]] += cell.n * p
                table[0, cell.votes[j]] += cell.n * (1 - p)
            sums = {truth: sum(table[truth, vote] for vote in (-1, 0, 1)) for truth in (0, 1)}
            chance.append({key: log(value / sums[key[0]]) for key, value in table.items()})
        prior = {}
        for kind in {cell.kind for cell in cells}:
            mine = [(cell.n, p) for cell, p in zip(cells, belief, strict=True) if cell.kind == kind]
            yes = SMOOTHING + sum(n * p for n, p in mine)
            prior[kind] = log(yes / (2 * SMOOTHING + sum(n for n, _ in mine) - yes))
        odds = [
            prior[c.kind] + sum(chance[j][1, vote] - chance[j][0, vote] for j, vote in enumerate(c.votes)) for c in cells
        ]
        before, belief = belief, [1 / (1 + exp(-min(30.0, max(-30.0, x)))) for x in odds]
        moved = max((abs(x - y) for x, y in zip(before, belief, strict=True)), default=0.0)
    return belief


def _inputs(cell: Cell) -> list[float]:
    one_hot = [float(cell.kind == kind.name) for kind in KINDS]
    return [1.0, *one_hot, *map(float, cell.flags), *map(float, cell.votes)]


def trained(cells: list[Cell], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic span classifier fitted to the estimated truth (bias, kinds, flags, votes)."""
    inputs, truth = [_inputs(cell) for cell in cells], posteriors(cells)
    mass = [log(1 + cell.n) for cell in cells]  # damped, so that one frequent form does not drown the rest
    total = sum(mass) or 1.0
    weights = [0.0] * (1 + len(KINDS) + len(FLAGS) + len(LABELERS))
    for _ in range(steps):
        slope = [ridge * w for w in weights]
        for x, t, m in zip(inputs, truth, mass, strict=True):
            z = sum(w * v for w, v in zip(weights, x, strict=True) if v)
            error = m / total * (1 / (1 + exp(-min(30.0, max(-30.0, z)))) - t)
            for i, v in enumerate(x):
                if v:
                    slope[i] += error * v
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fitted(spans: DataFrame) -> list[float]:
    """Counts of all candidates by kind, votes and flags go to the driver: a fixed set of cells, whatever the rows."""
    keys = ["kind", *[f"v_{name}" for name in LABELERS], *[f"x_{name}" for name in FLAGS]]
    rows = spans.groupBy(*keys).count().collect()
    split = 1 + len(LABELERS)
    cells = sorted((Cell(r[0], tuple(r[1:split]), tuple(r[split:-1]), r[-1]) for r in rows), key=repr)
    return trained(cells)


def _score(weights: list[float]) -> Column:
    bias, kinds, rest = weights[0], weights[1 : 1 + len(KINDS)], weights[1 + len(KINDS) :]
    z = F.lit(bias)
    for kind, weight in zip(KINDS, kinds, strict=True):
        z = z + F.when(F.col("kind") == kind.name, F.lit(weight)).otherwise(0.0)
    names = [*[f"x_{name}" for name in FLAGS], *[f"v_{name}" for name in LABELERS]]
    for name, weight in zip(names, rest, strict=True):
        z = z + F.col(name) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (``_row``, ``row``) and the accepted spans (``_row``, kind, start, end, hit, score, base).

    Base kinds that pass their own test are always accepted. Other candidates are accepted where
    the classifier gives ``THRESHOLD`` or more and no span of a kind listed earlier overlaps them.
    Null and empty texts have no spans. Repeated rows each have their own.
    """
    rows, found = candidates(docs)
    spans = landed(voted(found), "pii-votes")
    base = F.col("kind").isin(*BASE_KINDS)
    scored = spans.withColumn("score", _score(fitted(spans))).withColumn("base", base & F.col("valid"))
    accepted = scored.filter(F.col("base") | (~base & (F.col("score") >= THRESHOLD)))
    rank = F.create_map(*[x for name, place in ORDER.items() for x in (F.lit(name), F.lit(place))])
    levels = list(range(-len(KINDS) + 1, 1))
    ranked = accepted.withColumn("level", F.when(F.col("base"), 0).otherwise(-rank[F.col("kind")]))
    kept = overruled(ranked, "_row", levels, "kind").filter(F.col("base") | ~F.col("overruled"))
    return rows, kept.select("_row", "kind", "start", "end", "hit", "score", "base")


def listed(spans: DataFrame) -> DataFrame:
    """Per document with spans: counts of the base kinds, and base and all spans as ``kind:start:end`` lists."""
    rank = F.create_map(*[x for name, place in ORDER.items() for x in (F.lit(name), F.lit(place))])
    entry = F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind")

    def joined(entries: Column) -> Column:
        text = lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))
        return F.array_join(F.transform(F.sort_array(entries), text), ",")

    counts = [F.count_if(F.col("base") & (F.col("kind") == name)).alias(f"n_{name}") for name in BASE_KINDS]
    return spans.groupBy("_row").agg(
        *counts,
        joined(F.collect_list(F.when(F.col("base"), entry))).alias("base_spans"),
        joined(F.collect_list(entry)).alias("spans"),
    )
