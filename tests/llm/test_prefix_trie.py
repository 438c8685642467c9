"""Conversation tries against plain dictionaries of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import rng

from panelspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n double"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        paths[c] = tuple((own.get(c - c % 5, [])[:h] if rebuild else []) + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if paths[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def some_rows(seed):
    r, rows = rng(seed), []
    for c in range(150):
        if c % 17 == 3:
            continue
        n = r.choice([1, 2, 3, 6, 9, 14]) if c % 3 else 12
        for t in range(n):
            same = c % 3 == 0 and t < 11  # a third of all share a long beginning, or everything
            text = f"hot {t}" if same else r.choice(["é", "", "yes", "no " * 50, None, f"{r.randrange(4)}"])
            rows.append((c, None if t == 4 and c % 7 == 0 else t, r.choice(["user", None]) if not same else "user", "end" if c % 6 == 0 and t == 11 else text))
    rows += [(200, 0, "user", "x"), (200, 0, "user", "x"), (200, 0, "user", "a"), (None, 1, "user", "lost"), (203, 0, "", None), (204, None, None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_nodes_and_rebuilding(spark, shards):
    rows = some_rows(shards)
    turns = prefix_trie.ordered_turns(table(spark, rows)).persist()
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt_turns(turns), turns.select("conv").distinct(), shards=shards).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_as_they_are_and_small_shards(spark):
    rows = some_rows(9)
    got = prefix_trie.conversation_trie(table(spark, rows), shards=1, shard_turns=20).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, rebuild=False), key=str)


def test_chunks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, 0, "user", "same") for c in range(50)]
    got = prefix_trie.conversation_trie(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, rebuild=False), key=str)


def test_empty(spark):
    assert prefix_trie.conversation_trie(table(spark, [])).collect() == []
    assert prefix_trie.conversation_trie(table(spark, [(None, 0, "user", "x")])).collect() == []


def test_double_array():
    r = rng(4)
    words = sorted({tuple(r.randrange(1, 400) for _ in range(r.randrange(1, 5))) for _ in range(3000)})
    trie = prefix_trie.packed([list(w) for w in words])
    nodes = {w[:d] for w in words for d in range(len(w) + 1)}
    found = {}
    for w in nodes:
        s = 0
        for c in w:
            s = trie.child(s, c)
            assert s > 0
        found[w] = s
    assert len(set(found.values())) == len(nodes) == sum(c >= 0 for c in trie.check)
    assert all((w + (c,) in nodes) == (trie.child(found[w], c) > 0) for w in list(nodes)[:300] for c in range(1, 400))
    assert len(trie.check) < 3 * len(nodes) + 400
