"""Ranked lexical search: MaxScore over index shards, with bounds from precomputed term pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import landed, n_words, numbered, text_or_empty

TOP = 50
#: Words of the items that one index serves; more items go through further indexes.
BLOCK_WORDS = 100_000
#: An index shard ends at so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 8_192, 1_000_000
#: Each term of an item has a pair with so many terms that follow it by weight.
PAIR_REACH = 4
#: A pair's intersection list is stored up to this length; beyond it the joint maximum alone is.
PAIR_LIST = 256
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
#: Groups in which the tasks' best documents of an item meet first.
MERGE_SLOTS = 64

#: Terms are runs of ASCII letters and digits and of all other characters; A-Z in lower case.
_TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))

POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
SHARDS = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("starts", pa.binary()),
        ("places", pa.binary()),
        ("impacts", pa.binary()),
        ("pairs", pa.binary()),
        ("pair_tops", pa.binary()),
        ("pair_starts", pa.binary()),
        ("pair_places", pa.binary()),
    ]
)
FOUND = pa.schema([("item", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def term_counts(text: bytes, number: Callable[[bytes], int | None]) -> tuple[int, dict[int, int]]:
    """Number of terms of a UTF-8 text, and the occurrences of those with a number."""
    n, counts, rest = 0, Counter(), b""
    for at in range(0, len(text), SLICE):
        piece = rest + text[at : at + SLICE].translate(_TERMS)
        if at + SLICE < len(text):
            piece, _, rest = piece.rpartition(b" ")
        found = piece.split()
        n += len(found)
        counts.update(map(number, found))
    counts.pop(None, None)
    return n, counts


class Items:
    """The items of a block as lists of term numbers, and the vocabulary they share."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[tuple[int, list[int]]] = []
        for item, text in rows:
            fresh: dict[bytes, None] = {}
            term_counts(text.encode(errors="surrogatepass"), lambda term, seen=fresh: seen.setdefault(term))
            own = [self.vocabulary.setdefault(term, len(self.vocabulary)) for term in fresh]
            self.terms.append((item, own))

    def pairs(self, weights: np.ndarray) -> np.ndarray:
        """The pairs (smaller, larger term number) that the index holds, distinct and in order."""
        found = set()
        for _, own in self.terms:
            order = sorted((t for t in own if weights[t] > 0), key=lambda t: (-weights[t], t))
            for i, a in enumerate(order):
                found.update((min(a, b), max(a, b)) for b in order[i + 1 : i + 1 + PAIR_REACH])
        return np.array(sorted(found), np.int64).reshape(-1, 2)


def weight(n_docs: int, holding: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * holding + 1)))


# --- index -----------------------------------------------------------------------------------


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id``, number of terms and the vocabulary's occurrences of every document with a term, landed.

    One pass over the whole texts; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                n, counts = term_counts(text.as_py(), number)
                if n:
                    terms = np.array(sorted(counts), np.uint32)
                    tfs = np.array([counts[t] for t in terms.tolist()], np.uint32)
                    rows.append({"doc_id": doc_id, "n": n, "terms": terms.tobytes(), "tfs": tfs.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, POSTINGS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return landed(rows.mapInArrow(counted, _ddl(POSTINGS)), "postings")


def _holding(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term: one partial count per task and term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total[np.frombuffer(terms.as_py(), np.uint32)] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": used, "n": total[used]})

    out = np.zeros(size, np.int64)
    counts = rows.select("terms").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for row in counts.toLocalIterator():  # one row per term of the block
        out[row.term] = row.n
    return out


def _shard(rows: list[tuple], pairs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """Posting lists of the rows' documents with impacts, and the pairs' intersections with joint maxima."""
    sizes = [len(row[2]) // 4 for row in rows]
    terms = np.frombuffer(b"".join(row[2] for row in rows), np.uint32).astype(np.int64)
    tfs = np.frombuffer(b"".join(row[3] for row in rows), np.uint32).astype(np.int64)
    places = np.repeat(np.arange(len(rows)), sizes)
    spread = np.array([50 + 50 * row[1] * n_docs // n_terms for row in rows], np.int64)[places]
    impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * spread))
    order = np.argsort(terms, kind="stable")
    terms, places, impacts = terms[order], places[order], impacts[order]
    own, starts = np.unique(terms, return_index=True)
    starts = np.append(starts, len(terms))
    here = {term: at for at, term in enumerate(own.tolist())}
    kept, tops, lists = [], [], []
    for a, b in pairs.tolist():
        if a in here and b in here:
            x, y = (slice(starts[at], starts[at + 1]) for at in (here[a], here[b]))
            both, i, j = np.intersect1d(places[x], places[y], assume_unique=True, return_indices=True)
            kept.append((a, b))
            tops.append((impacts[x][i] + impacts[y][j]).max(initial=0))
            lists.append(both if len(both) <= PAIR_LIST else both[:0])
    return {
        "doc_ids": [row[0] for row in rows],
        "terms": own.tobytes(),
        "starts": starts.tobytes(),
        "places": places.astype(np.uint16).tobytes(),
        "impacts": impacts.tobytes(),
        "pairs": np.array(kept, np.int64).tobytes(),
        "pair_tops": np.array(tops, np.int64).tobytes(),
        "pair_starts": np.cumsum([0, *map(len, lists)]).astype(np.int64).tobytes(),
        "pair_places": np.concatenate([*lists, np.zeros(0)]).astype(np.uint16).tobytes(),
    }


def build_index(docs: DataFrame, items: Items) -> tuple[DataFrame, np.ndarray]:
    """The landed index of all documents for the items' vocabulary, one row per shard, and the term weights.

    A shard is a run of documents of one task, of bounded size.
    """
    rows = postings(docs, items)
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(n_docs, n) for n in _holding(rows, len(items.vocabulary)).tolist()], np.int64)
    pairs = items.pairs(weights)
    shared = docs.sparkSession.sparkContext.broadcast((weights, pairs))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = shared.value
        held, n = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(row)
                n += len(row[2]) // 4
                if len(held) >= SHARD_DOCS or n >= SHARD_POSTINGS:
                    yield pa.RecordBatch.from_pylist([_shard(held, pairs, weights, n_docs, n_terms)], SHARDS)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_shard(held, pairs, weights, n_docs, n_terms)], SHARDS)

    return landed(rows.mapInArrow(sharded, _ddl(SHARDS)), "search-index"), weights


# --- search ----------------------------------------------------------------------------------


class Shard:
    """One row of the index, and the search of an item in it."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        places, impacts = read("places", np.uint16), read("impacts", np.int64)
        self.lists, self.tops = {}, {}
        for term, (low, high) in zip(read("terms", np.int64).tolist(), pairwise(read("starts", np.int64).tolist()), strict=True):
            self.lists[term] = places[low:high], impacts[low:high]
            self.tops[term] = int(impacts[low:high].max())
        pairs = map(tuple, read("pairs", np.int64).reshape(-1, 2).tolist())
        bounds = pairwise(read("pair_starts", np.int64).tolist())
        self.pairs = dict(zip(pairs, zip(read("pair_tops", np.int64).tolist(), bounds, strict=True), strict=True))
        self.pair_places = read("pair_places", np.uint16)
        # Known, then ascending ids: how documents of one score follow each other.
        self.known = np.array([x is not None for x in self.doc_ids])
        self.order = np.array([0 if x is None else x for x in self.doc_ids], np.int64)

    def own_pairs(self, terms: list[int]) -> list[tuple[int, int, int]]:
        """The pairs among the terms, as places in the list, with their joint maxima."""
        out = []
        for i, a in enumerate(terms):
            for j in range(i + 1, len(terms)):
                held = self.pairs.get((min(a, terms[j]), max(a, terms[j])))
                if held:
                    out.append((i, j, held[0]))
        return out

    def bounds(self, terms: list[int], pairs: list[tuple[int, int, int]]) -> list[int]:
        """The most that the terms from each place on can add to one document's score.

        Alone that is the sum of their maxima. A pair adds at most the larger of its joint maximum
        and its two single ones, so disjoint pairs of the largest savings lower the sum.
        """
        top = [self.tops[t] for t in terms]
        saving = sorted(((top[i] + top[j] - max(joint, top[i], top[j]), i, j) for i, j, joint in pairs), reverse=True)
        saving = [x for x in saving if x[0] > 0]
        out, total = [0], 0
        for at in range(len(terms) - 1, -1, -1):
            total += top[at]
            used, less = set(), 0
            for amount, i, j in saving:
                if i >= at and i not in used and j not in used:
                    used |= {i, j}
                    less += amount
            # The bound of the longer list also holds for what follows without its first term.
            out.append(min(total - less, out[-1] + top[at]))
        return out[::-1]

    def _added(self, term: int, at: np.ndarray) -> np.ndarray:
        """What the term adds to the scores of the documents at these places."""
        places, impacts = self.lists[term]
        found = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[found] == at, impacts[found], 0)

    def seeds(self, terms: list[int], pairs: list[tuple[int, int, int]], top: int) -> np.ndarray:
        """Documents of the intersection lists with the largest joint maxima: likely high scores."""
        chosen, n = [], 0
        for i, j, _ in sorted(pairs, key=lambda p: -p[2]):
            low, high = self.pairs[min(terms[i], terms[j]), max(terms[i], terms[j])][1]
            chosen.append(self.pair_places[low:high])
            n += high - low
            if n >= 2 * top:
                break
        return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint16)

    def search(self, terms: list[int], best: Best) -> None:
        """Adds the documents that belong to the best ones of an item."""
        terms = sorted((t for t in terms if self.tops.get(t)), key=lambda t: (-self.tops[t], t))
        pairs = self.own_pairs(terms)
        bound = self.bounds(terms, pairs)
        if bound[0] < best.least:
            return
        scores = np.zeros(len(self.doc_ids), np.int64)
        open_ = np.ones(len(self.doc_ids), bool)
        seeds = self.seeds(terms, pairs, best.top)
        if len(seeds):
            for term in terms:
                scores[seeds] += self._added(term, seeds)
            best.add(scores[seeds], seeds, self)
            scores[seeds], open_[seeds] = 0, False
        done = 0
        # Documents without any of the terms so far can still reach the best.
        while done < len(terms) and bound[done] >= best.least:
            places, impacts = self.lists[terms[done]]
            scores[places] += impacts
            done += 1
        at = np.flatnonzero(open_ & (scores + bound[done] >= best.least) & (scores > 0))
        total = scores[at]
        for place in range(done, len(terms)):
            if not len(at):
                return
            total = total + self._added(terms[place], at)
            stay = total + bound[place + 1] >= best.least
            at, total = at[stay], total[stay]
        best.add(total, at, self)


class Best:
    """The best documents of an item so far, and the score that the next one must reach."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.known, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, places: np.ndarray, shard: Shard) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores = np.concatenate([self.scores, scores[fit]])
        known = np.concatenate([self.known, shard.known[places[fit]]])
        ids = np.concatenate([self.ids, shard.order[places[fit]]])
        first = np.lexsort((ids, known, -scores))[: self.top]
        self.scores, self.known, self.ids = scores[first], known[first], ids[first]
        if len(first) == self.top:
            self.least = max(1, int(self.scores[-1]))


def search(index: DataFrame, items: Items, top: int = TOP) -> DataFrame:
    """Rows (item, slot, doc_id, score) with the best documents of each item among those of each task."""
    shared = index.sparkSession.sparkContext.broadcast(items.terms)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [Best(top) for _ in shared.value]
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0])
                for own, (_, terms) in zip(best, shared.value, strict=True):
                    shard.search(terms, own)
        slot = TaskContext.get().partitionId() % MERGE_SLOTS
        rows = [
            {"item": item, "slot": slot, "doc_id": doc_id if known else None, "score": score}
            for own, (item, _) in zip(best, shared.value, strict=True)
            for score, known, doc_id in zip(own.scores.tolist(), own.known.tolist(), own.ids.tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_pylist(rows, FOUND)

    return index.mapInArrow(searched, _ddl(FOUND))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` best documents of each item.

    The index covers every document and the terms of a block of items; a block has ``BLOCK_WORDS``
    words and the rest of one item. Shards are searched one after the other in their task, so
    that the best so far let later shards skip. In a shard terms go by falling maximum: documents
    enter as long as the bound of the terms left reaches the best so far, and after that only
    those that can still reach it are looked up. The bound is the sum of maxima, lowered by the
    joint maxima of term pairs; documents of the pairs' intersection lists are scored first.
    Scores are exact. What is shuffled is at most ``top`` rows per task and item.

    Only scores above 0 count. Equal scores go by doc_id, null first. Null and empty texts have no
    terms; repeated documents each take a rank; each row of ``items`` is an item, so repeated
    ones have a ranking each, and one without a term none. No items or no documents: no rows.
    """
    own = items.select(F.col("item_id"), text_or_empty("text").alias("text"))
    own = landed(own.withColumn("_words", n_words(F.col("text"))), "search-items")
    placed = landed(numbered(own, ["item_id", "text"], "_words"), "search-blocks")
    placed = placed.withColumn("_block", F.expr(f"before div {BLOCK_WORDS}"))
    blocks = placed.agg(F.max("_block")).first()[0]
    found = None
    for number in range((-1 if blocks is None else blocks) + 1):
        block = Items([tuple(r) for r in placed.filter(F.col("_block") == number).select("rank", "text").collect()])
        if not block.vocabulary:
            continue
        index, _ = build_index(docs, block)
        rows = search(index, block, top)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _ddl(FOUND))
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    near = F.row_number().over(Window.partitionBy("item", "slot").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    found = found.withColumn("rank", near).filter(F.col("rank") <= top)
    found = found.withColumn("rank", last).filter(F.col("rank") <= top)
    names = placed.select(F.col("rank").alias("item"), "item_id")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
