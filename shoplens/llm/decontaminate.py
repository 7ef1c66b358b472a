"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed, n_words, numbered, packed, text_or_empty

TILE_WORDS = 5
#: Items of fewer words than a tile are looked for as a whole, from so many words on.
LEAST_WORDS = 3
MIN_COVERAGE = 0.75
#: Benchmark words that one pass over the documents carries to the tasks, under 100 bytes each.
BLOCK_WORDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BORDERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

PAIRS = "doc_id string, text_hash long, item_id string, n_tiles long, covered_words long, item_words long"


def words_of(text: str | None) -> list[bytes]:
    """Words without case and punctuation: runs of ASCII letters and digits and of all other characters."""
    return (text or "").encode(errors="surrogatepass").lower().translate(_BORDERS).split()


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


class Rolling:
    """Karp-Rabin hashes of windows of any length, from prefix sums of the words' hashes times powers."""

    def __init__(self, words: np.ndarray):
        few = len(words) < len(_UP)
        powers = _UP if few else _powers(_BASE, len(words))
        self.back = _DOWN if few else _powers(_INVERSE, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[: len(words)], out=self.sums[1:])

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def _open_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Where windows without a marked word start."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    used = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(used[size:] == used[:-size])


def tiles(doc: np.ndarray, item: np.ndarray, size: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length), longest first, no word in two tiles.

    Each round finds the greatest length of a match between unmarked words, by halving over the
    hashes of all open windows of a length, and marks all matches of that length that do not overlap, by place
    in the item, then in the document. What is held is a few numbers per word, however often words repeat.
    """
    doc_hashes, item_hashes = Rolling(doc), Rolling(item)
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Open windows of the document by hash, then place, and those of the item that have an equal one."""
        d, i = _open_windows(doc_marked, length), _open_windows(item_marked, length)
        mine, wanted = doc_hashes.windows(d, length), item_hashes.windows(i, length)
        order = np.argsort(mine, kind="stable")
        d, mine = d[order], mine[order]
        low = np.searchsorted(mine, wanted)
        there = mine[np.minimum(low, len(mine) - 1)] == wanted if len(mine) else np.zeros(len(wanted), bool)
        return d, mine, i[there], wanted[there]

    while most >= size:
        low, high = size - 1, most
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if len(shared(half)[2]) else (low, half - 1)
        if low < size:
            break
        d, mine, places, wanted = shared(low)
        for b, h in zip(places.tolist(), wanted, strict=True):
            if item_marked[b : b + low].any():
                continue
            for a in d[np.searchsorted(mine, h) : np.searchsorted(mine, h, "right")].tolist():
                if not doc_marked[a : a + low].any() and np.array_equal(doc[a : a + low], item[b : b + low]):
                    doc_marked[a : a + low] = item_marked[b : b + low] = True
                    out.append((a, b, low))
                    break
        most = low - 1
    return out


class Block:
    """Benchmark items as arrays of word hashes, and which items have each window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.names = size, []
        #: Hashes of the items' words; 0, which no word has, stands for all others.
        self.vocabulary: dict[bytes, int] = {}
        known: dict[bytes, int] = {}
        arrays = []
        for item_id, text in items:
            found = words_of(text)
            for word in found:
                if word not in self.vocabulary:
                    self.vocabulary[word] = xxhash.xxh3_64_intdigest(word) or 1
            words = self._hashed(found)
            if len(words) >= min(size, LEAST_WORDS):
                at = known.setdefault(words.tobytes(), len(arrays))
                if at == len(arrays):
                    arrays.append(words)
                    self.names.append([])
                self.names[at].append(item_id)
        self.lengths = np.array([len(words) for words in arrays], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = np.concatenate([*arrays, np.zeros(0, np.uint64)])
        #: By window size: distinct hashes, where each one's owners start, the owners, and how often they have it.
        self.indexes = {}
        for length in range(min(size, LEAST_WORDS), size + 1):
            own = [n for n, words in enumerate(arrays) if len(words) == length or len(words) > length == size]
            if own:
                hashes = [Rolling(arrays[n]).windows(np.arange(len(arrays[n]) - length + 1), length) for n in own]
                owners = np.repeat(np.array(own, np.int32), [len(h) for h in hashes])
                pairs, times = np.unique(
                    np.rec.fromarrays([np.concatenate(hashes), owners], names="h,n"), return_counts=True
                )
                seeds, first = np.unique(pairs["h"], return_index=True)
                self.indexes[length] = seeds, np.append(first, len(pairs)), pairs["n"].copy(), times.astype(np.int32)

    def _hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def item(self, n: int) -> np.ndarray:
        return self.words[self.starts[n] : self.starts[n + 1]]

    def found(self, text: str, least: float) -> Iterator[tuple[str, int, int, int]]:
        """(item, tiles, covered words, item words) of each item covered enough by the text."""
        doc = self._hashed(words_of(text))
        strange = doc == 0
        hashes = None
        for length, (seeds, first, owners, times) in self.indexes.items():
            at = _open_windows(strange, length)
            if not len(at):
                continue
            hashes = hashes or Rolling(doc)
            mine = hashes.windows(at, length)
            seed = np.minimum(np.searchsorted(seeds, mine), len(seeds) - 1)
            hit = seeds[seed] == mine
            shared = np.unique(seed[hit])
            if not len(shared):
                continue
            sizes = first[shared + 1] - first[shared]
            rows = np.repeat(first[shared] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            # Every window covers its own words at most, so items with too few shared ones need no tiling.
            items, inverse = np.unique(owners[rows], return_inverse=True)
            cover = np.bincount(inverse, times[rows]) * length
            for n in items[cover >= least * self.lengths[items]].tolist():
                yield from self._tiled(n, doc, at[hit], mine[hit], length, least)

    def _tiled(self, n: int, doc: np.ndarray, at: np.ndarray, mine: np.ndarray, length: int, least: float):
        item = self.item(n)
        windows = Rolling(item).windows(np.arange(len(item) - length + 1), length)
        if _covered(np.flatnonzero(np.isin(windows, mine)), length, len(item)).sum() < least * len(item):
            return
        # Only what the document shares with this item, its pieces kept apart.
        near = _covered(at[np.isin(mine, windows)], length, len(doc))
        places = np.flatnonzero(near)
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        piece = np.insert(doc[places], gaps, 0)
        found = tiles(piece, item, length)
        covered = sum(size for *_, size in found)
        if covered >= least * len(item):
            for name in self.names[n]:
                yield name, len(found), covered, len(item)


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change)[:n] > 0


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = TILE_WORDS, coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words ``coverage`` or more lie in tiles.

    Tiles are passages of at least ``size`` words that both have, in any order, so that reordered
    passages count. Case and punctuation are ignored. Items of fewer than ``size`` words have to occur as a
    whole; those of fewer than ``LEAST_WORDS`` words and null texts are never found. Equal items are
    all reported; repeated documents each give their pairs.
    The benchmark goes to the tasks in blocks of ``BLOCK_WORDS`` words (and the rest of one item),
    each with its own pass over the documents, however large the benchmark is; documents are
    not shuffled. A block is released after its pass.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), text_or_empty("text").alias("text"))
    items = landed(items.withColumn("_words", n_words(F.col("text"))), "benchmark")
    placed = landed(numbered(items, ["item_id", "text"], "_words"), "benchmark-blocks")
    placed = placed.withColumn("_block", F.expr(f"before div {BLOCK_WORDS}"))
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("string"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def tiled(block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [
                    (doc_id, text_hash, *pair)
                    for doc_id, text, text_hash in batch[["doc_id", "text", "text_hash"]].itertuples(index=False, name=None)
                    for pair in block.value.found(text, coverage)
                ]
                yield pd.DataFrame(found, columns=[part.split()[0] for part in PAIRS.split(", ")])

        return run

    blocks = placed.agg(F.max("_block")).first()[0]
    out = None
    for number in range((-1 if blocks is None else blocks) + 1):
        held = placed.filter(F.col("_block") == number).select("item_id", "text").collect()
        block = spark.sparkContext.broadcast(Block([tuple(row) for row in held], size))
        pairs = landed(rows.mapInPandas(tiled(block), PAIRS), "benchmark-pairs")
        block.unpersist()
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = spark.createDataFrame([], PAIRS)
    return out.withColumns({name: F.col(name).cast("long") for name in ("doc_id", "item_id")})


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    found = landed(contaminated(docs, benchmark).select("doc_id", "text_hash").distinct(), "contaminated")
    found = found.toDF("_doc", "_hash")
    rows = docs.select(packed(docs), "doc_id", F.xxhash64(text_or_empty("text")).alias("_text"))
    hit = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash"))
    return rows.join(found, hit, "left_anti").select("row.*")
