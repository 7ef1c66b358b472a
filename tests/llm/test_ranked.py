"""Ranked search against plain scoring, and its bounds."""

import collections
import random
import re
from math import floor, log

import numpy as np
import pytest
from corpus_cases import awkward_texts, documents, none_of

from shoplens.llm import ranked

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(texts, items, top):
    """texts and items: (id, text). Rankings as sorted lists of (score, doc_id), one per item."""
    bags = [(doc_id, collections.Counter(terms(text))) for doc_id, text in texts]
    bags = [(doc_id, bag) for doc_id, bag in bags if bag]
    total = sum(sum(bag.values()) for _, bag in bags)
    held = collections.Counter(t for _, bag in bags for t in bag)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            spread = 50 + 50 * sum(bag.values()) * len(bags) // total
            score = 0
            for t in set(terms(text)) & set(bag):
                weight = floor(1000 * log((2 * len(bags) + 2) / (2 * held[t] + 1)))
                score += weight * (1000000000 * bag[t] // (1000 * bag[t] + 20 * spread))
            if score:
                found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, rank + 1, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, top):
    table = spark.createDataFrame(items, "item_id long, text string, rank int, score long, _words long, doc_id long")
    return sorted((tuple(r) for r in ranked.ranked(docs, table, top).collect()), key=repr)


def padded(items):
    return [(*item, None, None, None, None) for item in items]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefé漢7") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [
        " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.choice([1, 3, 30, 200])))
        for _ in range(400)
    ]
    items = [(n, " ".join(rng.sample(vocabulary, rng.choice([1, 2, 8, 30])))) for n in range(40)]
    return [*awkward_texts(), *texts, *texts[:30]], items


def test_rankings_are_those_of_plain_scores(spark, corpus, monkeypatch):
    texts, items = corpus
    monkeypatch.setattr(ranked, "SHARD_DOCS", 50)
    monkeypatch.setattr(ranked, "BLOCK_WORDS", 100)
    monkeypatch.setattr(ranked, "SLICE", 1000)
    items = [*items, (None, "word one"), (50, None), (51, ""), (7, items[7][1]), (52, "ONE, two-THREE!"), (53, "x" * 100_000)]
    docs = documents(spark, texts).repartition(5)
    rows = [*enumerate(texts), (None, "text without an id and with seven words")]
    for top in (3, 50):
        assert found(spark, docs, padded(items), top) == plain(rows, items, top)


def test_no_items_or_documents_no_rows(spark, corpus):
    texts, items = corpus
    docs = documents(spark, texts)
    assert found(spark, none_of(docs), padded(items), 5) == []
    assert found(spark, docs, [], 5) == []
    assert found(spark, docs, padded([(1, "none-of-these-is-here")]), 5) == []


def shard_of(texts, items):
    block = ranked.Items(items)
    counts = [ranked.term_counts(text.encode(), block.vocabulary.get) for text in texts]
    rows = [
        (n, size, np.array(sorted(own), np.uint32).tobytes(), np.array([own[t] for t in sorted(own)], np.uint32).tobytes())
        for n, (size, own) in enumerate(counts)
    ]
    holding = collections.Counter(t for _, own in counts for t in own)
    weights = np.array([ranked.weight(len(rows), holding[t]) for t in range(len(block.vocabulary))], np.int64)
    made = ranked._shard(rows, block.pairs(weights), weights, len(rows), sum(size for size, _ in counts))
    return block, ranked.Shard(made)


def test_pair_bounds_hold_and_are_tighter_than_single_maxima(corpus):
    texts, items = [t for t in corpus[0] if t and terms(t)], corpus[1]
    block, shard = shard_of(texts, items)
    tighter = 0
    for _, own in block.terms:
        own = sorted((t for t in own if shard.tops.get(t)), key=lambda t: (-shard.tops[t], t))
        bounds = shard.bounds(own, shard.own_pairs(own))
        for at in range(len(own) + 1):
            scores = np.zeros(len(texts), np.int64)
            for t in own[at:]:
                places, impacts = shard.lists[t]
                scores[places] += impacts
            assert scores.max() <= bounds[at] <= sum(shard.tops[t] for t in own[at:])
            tighter += bounds[at] < sum(shard.tops[t] for t in own[at:])
    assert tighter > 100


def test_documents_are_skipped(corpus, monkeypatch):
    """With a high score to reach, few documents get a look-up; the rankings are the same with it from the start."""
    texts, items = [t for t in corpus[0] if t and terms(t)] * 5, corpus[1]
    block, shard = shard_of(texts, items)
    looked = []
    added = ranked.Shard._added
    monkeypatch.setattr(ranked.Shard, "_added", lambda self, term, at: looked.append(len(at)) or added(self, term, at))
    for _, own in block.terms:
        first, again = ranked.Best(5), ranked.Best(5)
        shard.search(own, first)
        looked.clear()
        again.least = first.least
        shard.search(own, again)
        assert again.scores.tolist() == first.scores.tolist() and again.ids.tolist() == first.ids.tolist()
        assert sum(looked) < 0.3 * len(own) * len(texts)


def test_terms_across_slices(monkeypatch):
    text = ("Ab, cd-EF é漢9 " * 50 + "x" * 500 + " y").encode()
    whole = ranked.term_counts(text, lambda t: len(t))
    for size in (7, 64, 333):
        monkeypatch.setattr(ranked, "SLICE", size)
        assert ranked.term_counts(text, lambda t: len(t)) == whole
