"""The conversation prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest

from cartograph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, least long"


def rebuilt(rows, borrow=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:56]
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}
    if not borrow:
        return own
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            n = todo.pop()
            leaves += not kids[n]
            saved += (len(members[n]) - 1) * (len(brute.words(n[-1][1])) if n else 0)
            todo += kids[n]
        return leaves, saved

    made = []
    for node, who in members.items():
        leaves, saved = below(node)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        made.append((min(who), len(node), parent, len(who), len(kids[node]), leaves, saved, digest))
    return sorted(made, key=repr)


def found(spark, rows, shard, borrow=True):
    turns = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(5)
    own = trie.paths(turns)
    nodes = trie.trie_nodes(trie.borrow_heads(own) if borrow else own, shard)
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


@pytest.mark.parametrize("shard", [3, 1000])
def test_every_node_of_random_conversations(spark, shard):
    rng = random.Random(shard)
    rows = []
    for c in [*range(120), -7, -23, 10**12 + 5]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant"]), rng.choice("ab") * 2 + " z"))
    assert found(spark, rows, shard) == plain_trie(rebuilt(rows))


def test_copies_and_long_paths_cross_shards(spark, monkeypatch):
    """A third of all conversations are copies, and long ones share all but the last turn."""
    monkeypatch.setattr(trie, "ID_CHUNK", 4)
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 300, 3) for t in range(3)]
    rows += [(c, t, "user", f"deep {t}" if t < 90 else f"{c} {t}") for c in range(1, 60, 3) for t in range(91)]
    rows += [(c, 0, "user", f"single {c}") for c in range(2, 120, 3)]
    assert found(spark, rows, 2, borrow=False) == plain_trie(rebuilt(rows, borrow=False))


def test_odd_conversations(spark):
    """Nulls, empty texts, repeated rows, long texts, and heads that leave a conversation without turns."""
    rows = [(0, None, None, None), (0, 0, "", ""), (0, 0, "", ""), (1, 5, "user", "w " * 100_000), (None, 0, "user", "x")]
    rows += [(c, 0, "user", "only") for c in range(40, 60)] + [(c, 0, "user", "only") for c in range(61, 70)]
    assert found(spark, rows, 2) == plain_trie(rebuilt(rows))
    assert any(not turns for turns in rebuilt(rows).values())
    assert found(spark, [], 2) == []
    assert found(spark, [(None, 0, "user", "x")], 2) == []


def test_nodes_of_two_ranges_are_in_the_skeleton(spark):
    rng = random.Random(5)
    paths = sorted({b"".join(bytes([rng.randint(1, 2)]) * trie.KEY for _ in range(rng.randint(0, 9))) for _ in range(400)})
    bone = trie.skeleton(paths, 20)
    held = {0: b""}
    for (above, key), node in bone.children.items():
        held[node] = held[above] + key
    shards = defaultdict(set)
    for p in paths:
        for k in range(0, len(p) + 1, trie.KEY):
            shards[p[:k]].add(trie.bisect_right(bone.splitters, p))
    assert {p for p, s in shards.items() if len(s) > 1} <= set(held.values())
    assert len(bone.splitters) > 10
