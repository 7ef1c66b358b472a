"""Recall and precision of the spans that votes and the classifier add, on planted data without any label."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from shoplens.llm import pii

FILL = "lorem ipsum dolor the with and of market river stone quick under".split()
KINDS = ["ssn", "iban", "local_phone", "person", "account", "secret"]


def iban(rng, country, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 4))
    rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def personal(rng, kind):
    """What stands before a piece of personal data, and the piece."""
    if kind == "ssn":
        number = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        return rng.choice(["My social security number is ", "ssn: ", "insurance no "]), number
    if kind == "iban":
        number = iban(rng, *rng.choice([("DE", 22), ("GB", 22), ("FR", 27), ("ES", 24), ("NL", 18)]))
        if rng.random() < 0.5:
            number = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
        return rng.choice(["IBAN ", "pay to account ", "bank: "]), number
    if kind == "local_phone":
        form = rng.choice(["({}) {}-{}", "{}-{}-{}"])
        return rng.choice(["call ", "phone: ", "tel "]), form.format(rng.choice([212, 415, 617]), rng.randint(300, 899), f"{rng.randint(0, 9999):04d}")
    if kind == "person":
        name = [rng.choice(part) for part in (["Mr.", "Mrs.", "Dr.", "Prof."], ["Anna", "James", "Maria", "Peter"], ["Smith", "Keller", "Dupont"])]
        return rng.choice(["signed ", "regards, ", "dear ", "from "]), " ".join(name)
    if kind == "account":
        return rng.choice(["account ", "customer ", "konto "]), str(rng.randint(10**9, 10**12 - 1))
    return rng.choice(["login ", "key ", "aws "]), "password=" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(14))


def decoy(rng, kind):
    """Something of the same outer form that is no personal data."""
    if kind == "ssn":
        return rng.choice(["part ", "version ", "page "]), f"{rng.choice([0, 666, 900 + rng.randint(0, 99)]):03d}-{rng.randint(0, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "iban":
        tail = "".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(rng.choice([12, 16, 19])))
        return rng.choice(["ticket ", "commit ", "code "]), f"{rng.choice(['XQ', 'ZZ', 'QA', 'DE', 'WW'])}{rng.randint(0, 99):02d}{tail}"
    if kind == "local_phone":
        return rng.choice(["version ", "isbn ", "ticket "]), f"{rng.choice([100, 123, 911, 199])}-{rng.choice([0, 1, 111, 123]):03d}-{rng.randint(0, 9999):04d}"
    if kind == "person":
        return rng.choice(["drink ", "page ", "version "]), rng.choice(["Dr. Pepper", "Mr. Clean", "Mr Robot", "Dr Strange"])
    if kind == "account":
        day = f"20{rng.randint(10, 24)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
        return rng.choice(["version ", "page ", "commit ", "isbn "]), rng.choice([day, f"000{rng.randint(10**6, 10**7)}00000000"])
    return rng.choice(["set ", "with ", "then "]), rng.choice(["token = something", "secret: absolutely", "password: required"])


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_data_is_found_and_decoys_are_left(spark, seed):
    rng = random.Random(seed)
    rows, planted = [], []
    for i in range(2400):
        real, kind = rng.random() < 0.5, rng.choice(KINDS)
        before, piece = (personal if real else decoy)(rng, kind)
        head = " ".join(rng.choice(FILL) for _ in range(6)) + f" {before}"
        rows.append((i, f"{head}{piece} {' '.join(rng.choice(FILL) for _ in range(4))}"))
        planted.append((real, kind, len(head), len(head) + len(piece)))
    docs, spans = pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    found = collections.defaultdict(list)
    for row in docs.join(spans, "_row").select("row.doc_id", "kind", "start", "end").collect():
        found[row.doc_id].append((row.kind, row.start, row.end))
    counts = collections.Counter()
    for (real, kind, start, end), own in zip(planted, (found[i] for i in range(len(rows))), strict=True):
        hit = any(s < end and start < e and (k == kind or not real) for k, s, e in own)
        counts[kind, real, hit] += 1
    caught = {k: counts[k, True, True] / (counts[k, True, True] + counts[k, True, False]) for k in KINDS}
    wrong = {k: counts[k, False, True] / (counts[k, False, True] + counts[k, False, False]) for k in KINDS}
    assert min(caught.values()) >= 0.85 and sum(caught.values()) / len(KINDS) >= 0.95, caught
    assert max(wrong.values()) <= 0.12 and sum(wrong.values()) / len(KINDS) <= 0.03, wrong


def test_estimation_runs_to_convergence(monkeypatch):
    rng = random.Random(5)
    cells = collections.Counter()
    for _ in range(3000):
        truth = rng.random() < 0.3
        votes = tuple(1 if (truth if rng.random() < 0.8 else not truth) else -1 for _ in range(4))
        cells[votes + (1, 1)] += 1
    table = [pii.Cell("ssn", votes, (0,) * len(pii.FLAGS), n) for votes, n in sorted(cells.items())]
    settled = pii.posteriors(table)
    monkeypatch.setattr(pii, "TOLERANCE", 1e-12)
    assert max(abs(a - b) for a, b in zip(settled, pii.posteriors(table), strict=True)) < 1e-3


def test_account_numbers_have_the_length_and_check_digits_of_their_country(spark):
    rng = random.Random(6)
    good = [iban(rng, c, n) for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()]
    bad = [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    texts = spark.createDataFrame([(x,) for x in [*good, *bad]], "hit string")
    assert [r[0] for r in texts.select(pii._mod_97(texts.hit)).collect()] == [True] * len(good) + [False] * len(bad)
    strict = next(kind.strict for kind in pii.KINDS if kind.name == "iban")
    assert texts.filter(texts.hit.rlike(strict)).count() == 2 * len(good)
    assert spark.createDataFrame([(g + "1",) for g in good[:20]], "hit string").filter(F.col("hit").rlike(strict)).count() == 0
