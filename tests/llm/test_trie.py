"""The prefix trie against a plain trie in Python."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from shoplens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x1 long, first long, p long, single boolean"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*row, *[None] * 5) for row in rows], SCHEMA)


def plain(rows):
    """(conv_id, depth, parent, members, children, leaves, saved, ends) of every node."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
    said = {conv: [t[2:] for t in own] for conv, own in turns.items()}
    nodes = {}
    for conv in sorted(said):
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - conv % 100 if conv >= 0 else conv + (-conv) % 100
        whole = said.get(base, [])[:h] + said[conv][h:]
        for d in range(len(whole) + 1):
            node = nodes.setdefault(tuple(whole[:d]), {"members": [], "ends": []})
            node["members"].append(conv)
            if d == len(whole):
                node["ends"].append(conv)
    below = collections.defaultdict(list)
    for key in nodes:
        if key:
            below[key[:-1]].append(key)
    out, sums = [], {}
    for key in sorted(nodes, key=len, reverse=True):
        node, children = nodes[key], below[key]
        chars = len(key[-1][1]) if key else 0
        leaves = sum(sums[c][0] for c in children) if children else 1
        saved = (len(node["members"]) - 1) * chars + sum(sums[c][1] for c in children)
        sums[key] = leaves, saved
        parent = nodes[key[:-1]]["members"][0] if key else None
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((node["members"][0], len(key), parent, len(node["members"]), len(children), leaves, saved, ends))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    out = trie.nodes(table(spark, rows)).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in out), key=lambda r: r[:2])


def talks(seed, n, alphabet="ab", longest=9):
    """Conversations that share starts, copies of one another, and awkward turns."""
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(n * 3), n):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice([*alphabet, "é漢", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, 3, None]), rng.choice(["u", "u", "u", "a", None]), text))
    return rows


def test_nodes_of_tangled_conversations(spark):
    rows = talks(1, 150) + [(-5, 0, "u", "a"), (-205, 1, "u", "a"), (None, 0, "u", "a"), (7000, None, None, None)]
    rows += [(7000 + k, 0, "u", "copy") for k in range(60)] + [(9000, 2, "u", "a")] * 3
    assert found(spark, rows) == plain(rows)


def test_long_and_common_conversations(spark):
    long = [(300, turn, "u", f"t{turn % 7}") for turn in range(3 * trie.CHUNK + 5)]
    copies = [(10_000 + 100 * k, turn, "u", f"c{turn}") for k in range(700) for turn in range(3)]
    rows = long + copies + [(conv + 1, turn, "u", text) for conv, turn, _, text in long]
    assert found(spark, rows) == plain(rows)


def test_a_crowded_sketch_changes_nothing(spark, monkeypatch):
    rows = talks(2, 120, alphabet="abcdefgh")
    monkeypatch.setattr(trie, "MIN_CELLS", 64)
    monkeypatch.setattr(trie, "MAX_CELLS", 64)
    assert found(spark, rows) == plain(rows)


def test_estimates_are_never_too_low(spark):
    rows = trie.prefixes(table(spark, talks(3, 100))).cache()
    count = collections.Counter((r.depth, r.x1, r.x2) for r in rows.collect())
    screened = trie.screened(rows).collect()
    assert all(count[r.depth, r.x1, r.x2] == 1 for r in screened if r.single)
    assert sum(r.single for r in screened) >= 0.9 * sum(n == 1 for n in count.values())


def test_single_turnless_and_no_conversations(spark):
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    for rows in ([(0, 0, "u", "a")], [(alone, 0, "u", "a")], [(alone, 0, "u", "a"), (alone + 400, 0, None, None)], [(None, 0, "u", "a")]):
        assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_the_table_of_the_driver(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path, columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    out = trie.nodes(spark.read.parquet(path)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in out), key=lambda r: r[:2]) == plain(rows)


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_cells_lie_in_the_sketch(size):
    rng = np.random.default_rng(1)
    x1, x2 = rng.integers(-(2**62), 2**62, (2, 1000))
    cells = trie.cells_of(np.arange(1000), x1, x2, size)
    assert all(0 <= c.min() and c.max() < size for c in cells)
    assert all(len(np.unique(c)) > 0.9 * size * (1 - np.exp(-1000 / size)) for c in cells)
