"""Secret spans against plain patterns, and held-out accuracy of the Markov models."""

import base64
import hashlib
import random
import re

import pytest
from corpus_cases import documents, none_of
from pyspark.sql import functions as F

from shoplens.llm import secret_scan

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                out.append((m.start(), place, m.end(), kind))
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(out)]


def secret_texts():
    rng = random.Random(5)
    pieces = ["token", "PassWord", "api_key", "apikey", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL"]
    pieces += ["abcdefgh", "0123456789abcdef", "deadbeef" * 4, "x", "é漢", "ſecret=", "toKen=", "A1b2C3d4E5", "/", "-", "_", ".", "\n"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    long = ["token" + " " * 50_000, "token=" + "a" * 50_000, "a" * 50_000, "AKIA" * 20_000, "Ab" * 30_000, "AB" * 30_000, "token " * 20_000]
    return [*made, *long, None, "", "token=secret: abcdefghij", 'token = "abcdefgh', "token==abcdefg"]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = secret_texts()
    found = {r.doc_id: r for r in secret_scan.secrets_of(documents(spark, texts)).select("row.doc_id", "*").collect()}
    assert len(found) == len(texts) + 1
    for i, text in enumerate(texts):
        expected = base_spans(text)
        assert found[i].base_spans.split(",") == (expected or [""]), text[:80]
        assert set(expected) <= set(found[i].spans.split(","))
        kinds = [span.split(":")[0] for span in expected]
        assert [found[i][f"n_{kind}"] for kind in LEAST] == [kinds.count(kind) for kind in LEAST]
        places = [int(span.split(":")[1]) for span in found[i].spans.split(",") if span]
        assert places == sorted(places)


def test_no_documents_no_spans(spark):
    assert secret_scan.secrets_of(none_of(documents(spark, ["token=abcdefghij"]))).count() == 0


def words(rng, n):
    syllables = ["con", "ti", "re", "ser", "ver", "ma", "lo", "ken", "der", "in", "sta", "pre", "for", "ble", "ing", "tion", "al"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def identifiers(rng, n):
    """Ordinary names, paths, numbers and words of 16 characters and more."""
    out = []
    while len(out) < n:
        own = words(rng, 4)
        form = rng.choice(
            [
                "_".join(own),
                "-".join(own).upper(),
                own[0] + "".join(w.capitalize() for w in own[1:]),
                "/".join(own),
                "".join(own),
                str(rng.randrange(10**16, 10**19)),
                f"{own[0]}_{own[1]}_{rng.randrange(2000)}",
            ]
        )
        if len(form) >= 16 and not form.endswith("="):
            out.append(form)
    return out


def randoms(rng, n):
    out = []
    for _ in range(n):
        raw = rng.randbytes(rng.choice([15, 18, 24, 30]))
        out.append(rng.choice([raw.hex().upper()[:40], base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().strip("=")]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_secrets_are_told_from_identifiers(spark, seed):
    """Kinds of secrets that no base pattern finds, among names that the models never saw."""
    rng = random.Random(seed)
    good, bad = identifiers(rng, 1500), [s for s in randoms(rng, 300) if len(s.rstrip("=")) >= 16]
    texts = [f"see {rng.choice(words(rng, 1))} {name} end" for name in good] + [f"use ({key}) now" for key in bad]
    found = secret_scan.secrets_of(documents(spark, texts)).select("row.doc_id", "n_random", "spans").collect()
    flagged = {r.doc_id for r in found if r.n_random}
    caught = sum(i in flagged for i in range(len(good), len(texts)))
    wrong = sum(i in flagged for i in range(len(good)))
    assert caught >= 0.95 * len(bad), (caught, len(bad))
    assert wrong <= 0.01 * len(good), wrong
    # The span is the string itself, in code points.
    spans = {r.doc_id: r.spans for r in found}
    exact = sum(spans[i] == f"random:5:{5 + len(texts[i]) - 10}" for i in range(len(good), len(texts)))
    assert exact >= 0.9 * len(bad)


def test_scores_are_sums_of_pair_weights(spark):
    samples = secret_scan.made_strings(spark, 300).withColumn("random", F.lit(True))
    names = [(name, False) for name in identifiers(random.Random(3), 400)]
    samples = samples.unionByName(spark.createDataFrame(names, "hit string, random boolean"))
    model = secret_scan.trained(samples)
    place = {c: i + 1 for i, c in enumerate(secret_scan.ALPHABET)}
    for hit, score in samples.limit(200).select("hit", model.score(F.col("hit"))).collect():
        codes = [0, *[place[c] for c in hit]]
        assert score == sum(model.weights[a * secret_scan.STATES + b] for a, b in zip(codes, codes[1:], strict=False))
    held = [name for name, _ in names if int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % 5 == 0]
    passed = samples.filter(F.col("hit").isin(held) & (model.score(F.col("hit")) >= model.threshold)).count()
    assert passed <= secret_scan.FALSE_SHARE * len(held)
    assert model.threshold >= secret_scan.LEAST_ODDS
