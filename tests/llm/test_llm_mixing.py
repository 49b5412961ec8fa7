"""Mixing sources to target weights: permutations, targets, and the recipe against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import pytest

from cartograph.llm import mixing, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, rank long, rid long, size string, target string"


def test_permutations_are_permutations_with_an_inverse():
    for n in [1, 2, 3, 4, 5, 16, 17, 100, 1023, 4097]:
        for seed in (0, -5, 2**62):
            index, size, seeds = np.arange(n), np.full(n, n), np.full(n, seed)
            there = mixing.permuted(index, size, seeds)
            assert sorted(there) == list(range(n))
            assert (mixing.permuted(there, size, seeds, back=True) == index).all()
    big = 10**12 + 7
    some = np.array([0, 1, big - 1])
    there = mixing.permuted(some, np.full(3, big), np.full(3, 9))
    assert (mixing.permuted(there, np.full(3, big), np.full(3, 9), back=True) == some).all()
    assert mixing.permuted(np.zeros(0), np.zeros(0), np.zeros(0)).size == 0
    # Different seeds give different orders.
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, s)) for s in (1, 2))
    assert (a == b).sum() < 20 and (a == np.arange(1000)).sum() < 20


def plain_targets(sizes):
    """By sharing the excess again and again, in exact fractions; ``sizes`` in order of the sources."""
    weight = {i: (3, 1, 2)[i % 3] for i in range(len(sizes))}
    left, target, free = Fraction(3 * sum(sizes), 2), [Fraction(0)] * len(sizes), set(weight)
    while left and free:
        unit, over = left / sum(weight[i] for i in free), Fraction(0)
        for i in list(free):
            target[i] += unit * weight[i]
            if target[i] >= 2 * sizes[i]:
                over += target[i] - 2 * sizes[i]
                target[i] = Fraction(2 * sizes[i])
                free.remove(i)
        left = over
    return target


def rows_of(seed, n=300):
    rng = random.Random(seed)
    named = ["hot"] * 30 + ["a", "b", "ü", None, "", "one", "c", "d"]
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 20, 60, 700])
        rows.append((rng.choice([i, i, 7]), rng.choice([None, ""]) if not words else "w " * words, rng.choice(named)))
    return [*rows, *rows[:20], (900, "x", "single"), (901, None, "nothing"), (None, "a b c", "b")]


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 1, 2, "s", "t") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("block", "in_shard"), [(1, 2000), (7, 16), (128, 16)])
def test_whole_mixture(spark, block, in_shard):
    rows = rows_of(block)
    made = mixing.mix(frame(spark, rows), block=block, slots=in_shard, shards=3)
    docs = made.documents.toPandas()
    per_doc = mixing.taken(made).collect()
    assert Counter((r["doc_id"], r["size"]) for r in per_doc) == Counter((d, len(brute.words(t))) for d, t, _ in rows)

    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    targets = plain_targets([sizes[s] for s in names])
    assert sum(targets) == Fraction(3 * sum(sizes.values()), 2)
    by_rank = docs.groupby("rank")
    for i, s in enumerate(names):
        assert set(by_rank.get_group(i)["source_size"]) == {sizes[s]}
        assert by_rank.get_group(i)["target"].iloc[0] == pytest.approx(float(targets[i]))

    # The recipe: shards are full, places are used once, every source comes to its target.
    slots, pieces = made.slots.toPandas(), made.pieces.toPandas()
    shards = slots.groupby("shard")["place"].agg([list, "size"])
    assert all(sorted(p) == list(range(n)) for p, n in zip(shards["list"], shards["size"], strict=True))
    assert (shards["size"] <= in_shard).all()
    got = pieces.merge(docs[["rid", "rank", "offset", "size"]], on="rid")
    words = got.groupby("rank")["length"].sum()
    for i in range(len(names)):
        assert abs(words.get(i, 0) - float(targets[i])) <= 1
    # Every slot is filled without a gap, by consecutive words of its source.
    assert (got["start"] + got["length"] <= got["size"]).all()
    merged = pieces.merge(slots, on=["shard", "place"]).sort_values(["shard", "place", "at"])
    for _, part in merged.groupby(["shard", "place"]):
        ends = np.cumsum(part["length"])
        assert list(part["at"]) == [0, *ends[:-1]] and ends.iloc[-1] == part["words"].iloc[0]
    assert slots["words"].sum() == pieces["length"].sum()
    # No word is taken more than twice, and a block is taken again only after all others.
    times = slots.groupby(["rank", "block"]).size().unstack(fill_value=0)
    per_source = slots.groupby(["rank"])["block"].nunique()
    for rank, n in per_source.items():
        counts = times.loc[rank][: -(-sizes[names[rank]] // block)]
        assert counts.max() - counts.min() <= 1
    assert all(r["taken"] <= 2 * r["size"] for r in per_doc)


def test_reruns_agree_however_the_rows_are_dealt(spark):
    rows = rows_of(3)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    runs = [
        sorted((tuple(r) for r in mixing.taken(mixing.mix(frame(spark, given, parts), block=9)).collect()), key=repr)
        for given, parts in ((rows, 1), (shuffled, 7))
    ]
    assert runs[0] == runs[1]


def test_shards_are_mixed(spark):
    """Counts of a source in a shard are near its share, and differ from shard to shard."""
    counts = mixing.draw(np.array([6000, 3000, 1000]), 1000, [1, 2])
    assert sum(counts).tolist() == [6000, 3000, 1000] and {int(c.sum()) for c in counts} == {1000}
    first = [int(c[0]) for c in counts]
    assert len(set(first)) > 3 and all(540 < x < 660 for x in first)


def test_many_sources_are_drawn_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 4)
    rows = [(i, "w " * 40, f"s{i:02}") for i in range(11)]
    made = mixing.taken(mixing.mix(frame(spark, rows), block=8)).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in made)


def test_odd_tables(spark):
    assert mixing.taken(mixing.mix(frame(spark, [], 1))).collect() == []
    nothing = mixing.taken(mixing.mix(frame(spark, [(1, None, None), (2, "", "a")], 2))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
    long = mixing.taken(mixing.mix(frame(spark, [(1, "w " * 300_000, "a")], 1))).collect()
    assert [(r["size"], r["taken"]) for r in long] == [(300_000, 450_000)]


def test_query_on_documents(spark):
    rows = queries.op12_source_mixing(spark, SMALL).toPandas()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert rows.columns.tolist() == ["doc_id", "size", "source_size", "target", "taken"]
    assert rows["target"].groupby(rows["target"]).first().size > 1
    assert abs(rows["taken"].sum() - 1.5 * rows["size"].sum()) <= 20
