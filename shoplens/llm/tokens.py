"""Token ids of documents, packed with a canonical length-limited Huffman code."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import landed, text_or_empty
from shoplens.session import shared_dir

END_ID = 2
MAX_BITS = 20
BLOCK_IDS = 1 << 18
CHECKPOINT_IDS = 256
#: Ids that are packed in one step, a multiple of the former.
PACK_IDS = 1 << 14
#: Memory of a worker's remembered pieces of text, in each of two generations.
CACHE_BYTES = 48 << 20
#: Code points of the longest piece that is remembered.
LONG_PIECE = 64
#: Text whose pieces are told apart in one step.
STRETCH_BYTES = 8 << 20
#: Text whose pieces are found, and different pieces whose ids are looked up, in one step.
PART_BYTES, TOGETHER = 1 << 19, 1 << 13
#: What an entry takes besides its characters and ids.
_ENTRY_BYTES = 200
_ENCODED = pa.schema(
    [("doc_id", pa.string()), ("range", pa.int32())]
    + [(name, pa.int64()) for name in ("before", "n")]
    + [(name, pa.binary()) for name in ("ids", "counts")]
)


def _byte_signs() -> list[str]:
    """The printable sign by which byte-level vocabularies spell each byte: itself, or one past Latin-1."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = {byte: 0x100 + place for place, byte in enumerate(b for b in range(256) if b not in printable)}
    return [chr(moved.get(byte, byte)) for byte in range(256)]


_BYTE_SIGNS = "".join(_byte_signs())


def _spelled(pieces: list[str]) -> list[str]:
    """The pieces, which have no zero byte, by the signs of their bytes."""
    return codecs.charmap_decode("\0".join(pieces).encode(), "strict", _BYTE_SIGNS)[0].split(_BYTE_SIGNS[0])


_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A piece that the library's splitting rule makes of a word, a number, punctuation or a single line
#: break, without apostrophes and other scripts.
_PLAIN = re.compile(rf" ?{_LETTER}+| ?[0-9]+| ?[{re.escape(_PUNCTUATION)}]+|\n").fullmatch
_OTHER, _GAP, _LINE, _WORD, _NUMBER, _SIGN = range(6)


def _byte_kinds() -> np.ndarray:
    """Kind of each byte of UTF-8 text; those of characters past ASCII are settled by two of them."""
    kinds = np.zeros(256, np.uint8)
    for kind, signs in ((_GAP, " "), (_LINE, "\n"), (_NUMBER, "0123456789"), (_SIGN, _PUNCTUATION)):
        kinds[list(signs.encode())] = kind
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = _WORD
    return kinds


_KINDS = _byte_kinds()
#: Bytes that begin a character which surely is no white space: printable ASCII and U+00C0 to U+027F.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xCA] = True


def _kinds(data: np.ndarray) -> np.ndarray:
    kinds = _KINDS[data]
    high = np.flatnonzero(data[:-1] >= 0xC3)
    lead, follower = data[high], data[high + 1]
    letter = (lead < 0xC9) & ~((lead == 0xC3) & ((follower == 0x97) | (follower == 0xB7))) | (lead == 0xC9) & (follower < 0x90)
    kinds[high[letter]] = kinds[high[letter] + 1] = _WORD
    return kinds


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that begin at ``starts`` (ascending, different, the first 0).

    The library's rule always cuts before a space that a word follows. What is between two such cuts
    is cut further if it consists of plain pieces alone, and else stays one piece.
    """
    kinds = _kinds(data)
    head = np.zeros(len(data), bool)
    head[:-1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
    head[starts[1:] - 1] = False  # the last of a text
    odd = (kinds == _OTHER) | (kinds == _GAP) & ~head
    first = head.copy()
    first[starts] = True
    odd[:-1] |= (kinds[:-1] == _LINE) & (kinds[1:] == _LINE) & ~first[1:]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kinds[1:] != kinds[:-1]) & ~head[:-1] | (kinds[1:] == _LINE)
    chunks = np.flatnonzero(first)
    strange = np.unique(np.searchsorted(chunks, np.flatnonzero(odd), "right") - 1)
    ends = np.append(chunks[1:], len(data))
    mended = np.zeros(len(data) + 1, np.int8)
    mended[chunks[strange]] += 1
    mended[ends[strange]] -= 1
    inner &= ~np.cumsum(mended[:-1], dtype=np.int8).view(bool)
    return np.flatnonzero(first | inner)


def _all_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_cuts`` of the texts with these offsets, found in parts that fit a cache."""
    begins = np.unique(at[:-1][at[1:] > at[:-1]])
    parts, first = [], 0
    while first < len(begins):
        after = max(first + 1, int(np.searchsorted(begins, begins[first] + PART_BYTES)))
        low, high = begins[first], begins[after] if after < len(begins) else len(data)
        parts.append((low + _cuts(data[low:high], begins[first:after] - low)).astype(np.int32))
        first = after
    return np.concatenate(parts)


class _Recent:
    """A cache within a bound of memory: what is found in the older generation moves to the newer one."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        self.make, self.limit, self.held, self.newer, self.older = make, limit, 0, {}, {}

    def _added(self, keys: list[str], values: list[bytes]) -> None:
        for key, value in zip(keys, values, strict=True):
            if len(key) <= LONG_PIECE:
                self.held += _ENTRY_BYTES + len(key)
                self.newer[key] = value
        if self.held > self.limit:
            self.older, self.newer, self.held = self.newer, {}, 0

    def values(self, keys: list[str]) -> list[bytes]:
        """The values of different keys."""
        found = [*map(self.newer.get, keys)]
        absent = [i for i, value in enumerate(found) if value is None]
        moved = [keys[i] for i in absent]
        values = [*map(self.older.get, moved)]
        new = [key for key, value in zip(moved, values, strict=True) if value is None]
        made = iter(self.make(new))
        values = [next(made) if value is None else value for value in values]
        for i, value in zip(absent, values, strict=True):
            found[i] = value
        self._added(moved, values)
        return found


class Encoder:
    """Whole texts to ids with the tokenizers library, without special tokens being added.

    For byte-level BPE vocabularies texts are cut in bulk into pieces, where the library's own splitting
    rule always cuts as well; each different piece of a stretch of texts is looked up once, and its
    ids are remembered. Texts with special tokens go through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.cut = (
            spec["model"]["type"] == "BPE"
            and not spec["normalizer"]
            and not spec["post_processor"]
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not any(token["content"] == " " or _PLAIN(token["content"]) for token in spec["added_tokens"])
        )
        self.added = [token["content"] for token in spec["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.typecode = "H" if self.width.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.pieces = _Recent(self._made, CACHE_BYTES)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.typecode, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _odd(self, piece: str) -> bytes:
        if any(token in piece for token in self.added):
            return self._whole(piece)
        spelled = [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        return self._bytes([token.id for part in spelled for token in self.model.tokenize(part)])

    def _made(self, pieces: list[str]) -> list[bytes]:
        plain = [*map(_PLAIN, pieces)]
        alike = [piece for piece, fits in zip(pieces, plain, strict=True) if fits]
        ids, sizes = [], []
        for signs in _spelled(alike) if alike else []:
            split = self.model.tokenize(signs)
            sizes.append(len(split))
            ids += [token.id for token in split]
        every, at, width = self._bytes(ids), 0, self.width.itemsize
        cuts = iter(np.cumsum(np.array(sizes, np.int64) * width).tolist())
        out = []
        for piece, fits in zip(pieces, plain, strict=True):
            if fits:
                before, at = at, next(cuts)
                out.append(every[before:at])
            else:
                out.append(self._odd(piece))
        return out

    def _special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for token in self.added:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def encoded(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text (no nulls) and ``end``, as little-endian unsigned integers of the vocabulary's width."""
        if not self.cut:
            return pa.array([self._whole(text) + end for text in texts.to_pylist()], pa.binary())
        texts = texts.cast(pa.string())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        if not len(data):
            return pa.array([end] * len(texts), pa.binary())
        cuts = _all_cuts(data, at)
        special = np.flatnonzero(self._special(texts))
        if len(special):
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, at[special] + 1, 1)
            np.add.at(inside, at[special + 1], -1)
            cuts = cuts[np.cumsum(inside, dtype=np.int8)[cuts] == 0]
        offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        pieces = pa.StringArray.from_buffers(len(cuts), offsets, pa.py_buffer(data)).dictionary_encode()
        different, known = pieces.dictionary, []
        for first in range(0, len(different), TOGETHER):
            known += self.pieces.values(different.slice(first, TOGETHER).to_numpy(zero_copy_only=False).tolist())
        ids = pa.array([*known, end], pa.binary())
        ends = np.searchsorted(cuts, at[1:])  # pieces up to the end of each text
        every = np.insert(pieces.indices.to_numpy(), ends, len(known))
        out = ids.take(pa.array(every))
        last = np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1][ends + np.arange(1, len(texts) + 1)]
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(texts), [None, pa.py_buffer(np.append(0, last).astype(np.int32)), out.buffers()[2]]
        )

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of the vocabulary's width."""
        return self.encoded(pa.array([text], pa.string()))[0].as_py()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Code length of each symbol (0 for those that don't occur), optimal under ``max_bits``: package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids have no code of at most {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf_flags, row = [], weights
    for level in range(max_bits):
        if level:
            pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            by = np.argsort(both, kind="stable")
            row, is_leaf = both[by], by < len(weights)
        else:
            is_leaf = np.ones(len(weights), bool)
        leaf_flags.append(is_leaf)
    depth, take = np.zeros(len(weights), np.uint8), 2 * len(weights) - 2
    for is_leaf in reversed(leaf_flags):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id: the lengths alone determine them."""
    codes = np.zeros(len(lengths), np.uint64)
    code = previous = 0
    for symbol in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[symbol]) - previous
        previous = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, and the bit offset of every ``CHECKPOINT_IDS``-th of them; in steps that fit a cache.

    Two successive codes, of 40 bits at most, are moved as one.
    """
    sizes = np.append(lengths.astype(np.uint8), np.uint8(0))  # the last is that of a filler
    codes = np.append(codes.astype(np.uint64), np.uint64(0))
    total = int(np.bincount(ids, minlength=len(lengths)) @ lengths.astype(np.int64)) if len(ids) else 0
    out = np.zeros((total >> 6) + 2 if len(ids) else 0, np.uint64)
    checkpoints, at = [], 0
    for first in range(0, len(ids), PACK_IDS):
        part = ids[first : first + PACK_IDS].astype(np.int64)
        if len(part) % 2:
            part = np.append(part, len(lengths))
        left, right = part[::2], part[1::2]
        low_size = sizes[right].astype(np.uint64)
        value = codes[left] << low_size | codes[right]
        size = sizes[left].astype(np.int64) + low_size.view(np.int64)
        ends = np.cumsum(size) + at
        starts = ends - size
        checkpoints.append(starts[:: CHECKPOINT_IDS // 2].copy())
        word = starts >> 6
        room = 64 - (starts & 63) - size  # bits left behind the codes in their word
        over = np.flatnonzero(room < 0)
        head = value << np.maximum(room, 0).view(np.uint64)
        head[over] = value[over] >> (-room[over]).view(np.uint64)
        firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        # Bits of different codes never meet, so sums are unions.
        out[word[firsts]] += np.add.reduceat(head, firsts)
        out[word[over] + 1] += value[over] << (64 + room[over]).view(np.uint64)
        at = int(ends[-1])
    return out.astype(">u8").tobytes(), np.concatenate([*checkpoints, np.zeros(0, np.int64)])


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of as many bits as the longest code: id * 32 + length of the code it starts with."""
    bits = max(1, int(lengths.max(initial=0)))
    symbols = np.array(sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)), np.int64)
    spans = 1 << (bits - lengths[symbols].astype(np.int64))
    table = np.repeat(symbols << 5 | lengths[symbols], spans)
    kind = np.int32 if len(lengths) < 1 << 26 else np.int64
    return np.concatenate([table, np.full((1 << bits) - len(table), 1, np.int64)]).astype(kind), bits


def unpack(data: bytes, checkpoints: np.ndarray, n_ids: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints are decoded side by side."""
    if not n_ids:
        return np.zeros(0, np.int64)
    words = np.concatenate([np.frombuffer(data, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = words[:-1] << np.uint64(32) | words[1:]
    at, last = checkpoints.astype(np.int64).copy(), len(pairs) - 1
    out = np.empty((min(CHECKPOINT_IDS, n_ids), len(at)), table.dtype)
    top, mask = 64 - bits, np.uint64((1 << bits) - 1)
    for row in out:
        shift = (top - (at & 31)).view(np.uint64)
        found = table[((pairs[np.minimum(at >> 5, last)] >> shift) & mask).view(np.int64)]
        np.right_shift(found, 5, out=row)
        at += found & 31
    return out.T.reshape(-1)[:n_ids]


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of the batch, in runs of rows of about ``STRETCH_BYTES`` of text; at least one row each."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + STRETCH_BYTES, "right")) - at)
        yield batch.column(0).slice(at, n), batch.column(1).slice(at, n)
        at += n


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``range``, ``before``, ``n`` and ``ids`` in ascending order of doc_id, landed.

    The order is by doc_id (null first), then text; ``range`` numbers the sorted pieces of the
    table and ``before`` counts the ids of earlier documents of the same piece. Each piece ends with a
    row without ids: ``counts`` of each id in it.
    """
    text = text_or_empty("text")
    order = ["doc_id", "_hash", "text"]
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"))
    rows = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions(*order)
    rows = rows.select(F.col("doc_id").cast("string"), "text")  # as text, since pandas has no whole numbers with nulls

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(vocabulary), 0
        end = np.array([end_id], own.width).tobytes()
        here = TaskContext.get().partitionId()
        counts = np.zeros(max(own.size, end_id + 1), np.int64)
        for batch in batches:
            for doc_ids, texts in _stretches(batch):
                ids = own.encoded(texts, end)
                ends = np.frombuffer(ids.buffers()[1], np.int32).astype(np.int64) // own.width.itemsize
                counts += np.bincount(np.frombuffer(ids.buffers()[2], own.width, int(ends[-1])), minlength=len(counts))
                n, sizes = len(ids), np.diff(ends)
                numbers = [pa.array(x) for x in (np.full(n, here, np.int32), before + ends[:-1], sizes)]
                yield pa.RecordBatch.from_arrays([doc_ids, *numbers, ids, pa.nulls(n, pa.binary())], schema=_ENCODED)
                before += int(ends[-1])
        if before:
            last = {"range": here, "before": before, "n": 0, "counts": counts.tobytes()}
            yield pa.RecordBatch.from_pylist([last], _ENCODED)

    schema = "doc_id string, range int, before long, n long, ids binary, counts binary"
    return landed(rows.mapInArrow(tokenized, schema), "token-ids")


def _width(vocabulary: str) -> np.dtype:
    return encoder(vocabulary).width


def write_packed(docs: DataFrame, path: str, vocabulary: str, max_bits: int = MAX_BITS) -> None:
    """Writes ``path``/codes (id, length) and ``path``/blocks.

    A block holds the ids of whole documents in ascending order, at least ``BLOCK_IDS`` of them
    unless its range ends: ``start`` (ids of all documents before it), the documents' ids and
    sizes, the bits, and the bit offsets of every ``CHECKPOINT_IDS``-th id. It is decoded without
    any other block. Null and empty texts hold the end id alone; repeated ids keep all their rows;
    an empty table writes no blocks. What reaches the driver is one count per vocabulary entry and
    one total per range.
    """
    spark = docs.sparkSession
    every = encoded(docs, vocabulary)
    rows = every.filter("ids is not null").drop("counts")
    width = _width(vocabulary)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in batch["counts"]:
                part = np.frombuffer(own, np.int64)
                total = total + part if len(total) else part
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    parts = every.select("counts").filter("counts is not null").mapInPandas(counted, "id long, n long")
    counts = parts.groupBy("id").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(1 + max((row.id for row in counts), default=0), np.int64)
    for row in counts:
        frequency[row.id] = row.n
    lengths = code_lengths(frequency, max_bits)
    codes = canonical_codes(lengths)
    entries = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(entries, "id long, length int").coalesce(1).write.parquet(f"{path}/codes")

    totals = rows.groupBy("range").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("range").collect()
    starts, start = {}, 0
    for row in totals:
        starts[row.range] = start
        start += row.n

    def block(parts: list[tuple]) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(part[4] for part in parts), width)
        data, checkpoints = pack(ids, lengths, codes)
        first = parts[0]
        return pd.DataFrame(
            {
                "start": [starts[first[1]] + first[2]],
                "n_ids": [len(ids)],
                "doc_ids": [[part[0] for part in parts]],
                "sizes": [[int(part[3]) for part in parts]],
                "checkpoints": [checkpoints.astype("<i8").tobytes()],
                "bits": [data],
            }
        )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _encoders.clear()  # the workers are those that encoded
        parts, held, due = [], 0, None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if parts and (held >= BLOCK_IDS or (row[1], row[2]) != due):
                    yield block(parts)
                    parts, held = [], 0
                parts.append(row)
                held += row[3]
                due = (row[1], row[2] + row[3])
        if parts:
            yield block(parts)

    schema = "start long, n_ids long, doc_ids array<string>, sizes array<long>, checkpoints binary, bits binary"
    blocks = rows.mapInPandas(packed, schema)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_packed(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` (null unless asked for) of each packed document."""
    entries = spark.read.parquet(f"{path}/codes").collect()  # one row per vocabulary entry
    lengths = np.zeros(1 + max((row.id for row in entries), default=0), np.uint8)
    for row in entries:
        lengths[row.id] = row.length

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bits = decode_table(lengths)
        for batch in batches:
            for start, n_ids, doc_ids, sizes, checkpoints, data in batch.itertuples(index=False, name=None):
                ids = unpack(data, np.frombuffer(checkpoints, "<i8"), n_ids, table, bits).astype("<u4")
                sizes = np.asarray(sizes, np.int64)
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                yield pd.DataFrame(
                    {
                        "doc_id": doc_ids,
                        "start": start + ends - sizes,
                        "n_tokens": sizes,
                        "ids_crc32": [zlib.crc32(part.tobytes()) for part in each],
                        "ids": [part.tolist() for part in each] if with_ids else None,
                    }
                )

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long, ids array<long>"
    rows = spark.read.parquet(f"{path}/blocks").mapInPandas(decoded, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def packed_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Packs documents into a new folder of the shared space and reads them back, without the ids themselves."""
    path = shared_dir(docs.sparkSession, "packed-ids")
    write_packed(docs, path, vocabulary)
    return read_packed(docs.sparkSession, path, with_ids=False).drop("ids")
