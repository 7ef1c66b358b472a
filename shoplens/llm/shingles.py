"""Word shingles of texts as 64-bit hashes, and SuperMinHash signatures of their sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 36, 4
COMPONENTS = BANDS * BAND_ROWS
#: Shingles whose permutations are built at the same time: bounds the memory of a worker.
BLOCK = 16_384
CACHE_WORDS = 150_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Recent(dict):
    """A cache of bounded size in two generations: what is found in the older one moves to the newer."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_word_hash = Recent(xxhash.xxh3_64_intdigest, CACHE_WORDS)


def forget() -> None:
    """Empties the cache: a worker process outlives its task and serves other operators."""
    _word_hash.clear()
    _word_hash.older = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs of anything but ASCII white space), A-Z in lower case."""
    found = text.encode(errors="surrogatepass").lower().split()
    return np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles; of all words as one if there are fewer; empty without words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(len(words), SHINGLE_WORDS)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + words[k : len(words) - size + 1 + k])
    return np.unique(total)


def _batches(sets: Sequence[np.ndarray]) -> list[list[int]]:
    out, held = [[]], 0
    for i, elements in enumerate(sets):
        if held and held + len(elements) > BLOCK:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(elements)
    return out


def signatures(sets: Sequence[np.ndarray], components: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set: rank of the component in an element's own permutation
    (upper 32 bits) and a random fraction (lower 32 bits), least over the elements.

    Each element draws one permutation for all components, one place of it per level. A set is
    done as soon as every component has a value below the level, since later levels cannot lower
    any; so large sets stop after a few levels. Sets are processed in blocks of elements.
    """
    out = np.full((len(sets), components), _NONE)
    for batch in _batches(sets):
        elements = np.concatenate([sets[i] for i in batch])
        owners = np.repeat(np.array(batch, np.int64), [len(sets[i]) for i in batch])
        for at in range(0, len(elements), BLOCK):
            _lower(out, elements[at : at + BLOCK], owners[at : at + BLOCK])
    return out


def _lower(out: np.ndarray, elements: np.ndarray, owners: np.ndarray) -> None:
    components = out.shape[1]
    flat = out.reshape(-1)
    order = np.empty((len(elements), components), np.uint16)
    order[:] = np.arange(components, dtype=np.uint16)
    for level in range(components):
        floor = np.uint64(level << 32)
        present = np.unique(owners)
        unfinished = present[out[present].max(axis=1) >= floor]
        if len(unfinished) < len(present):
            stay = np.isin(owners, unfinished)
            elements, owners, order = elements[stay], owners[stay], order[stay]
        if not len(elements):
            return
        draw = mixed(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(components - level) >> np.uint64(32)).astype(np.int64) + level
        rows = np.arange(len(elements))
        component = order[rows, place].astype(np.int64)
        order[rows, place] = order[:, level]
        np.minimum.at(flat, owners * components + component, floor | draw >> np.uint64(32))


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature, as signed numbers; keys of different bands differ."""
    bands = rows.reshape(len(rows), -1, BAND_ROWS)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for k in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return keys.view(np.int64)
