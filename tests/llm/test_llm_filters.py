"""Quality rules, SimHash, substring removal, decontamination, packing and the pipeline."""

from __future__ import annotations

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartograph.llm import decontaminate, packing, quality, simhash, substring
from cartograph.llm.components import components

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators would like to use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rules string, row long, fingerprint int, whole_text string, kept_words string"


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", "  \n\t ", "one", "one two", "# * $ % & | < >", "é ß Ñ x y", passage, passage]
    texts += ["\n".join(["same line here"] * 30), "a " * 300, "LOUD WORDS " * 40]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))) for _ in range(25)]
    texts += [f"{rng.choice(vocabulary)} {passage} {rng.choice(vocabulary)} tail {i}" for i in range(12)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(30_000))]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "x", i, 1, "y", "z") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts_and_verdicts(odd, none):
    judged, rules = quality.quality_rules(odd)
    assert judged.columns == [*odd.columns, rules]
    got = {r["doc_id"]: r[rules] for r in judged.collect()}
    want = {r[0]: brute.counts(r[1]) for r in odd_rows()}
    hosts = brute.bad_hosts([(r[3], brute.rule_failed(want[r[0]])) for r in odd_rows()])
    for row in odd_rows():
        c = want[row[0]]
        assert {k: got[row[0]][k] for k in c} == c
        assert got[row[0]]["base_failed"] == brute.base_failed(c)
        assert got[row[0]]["kept"] == (not brute.rule_failed(c) and row[3] not in hosts)
    assert quality.keep_good(none).collect() == []


def test_a_bad_host_takes_its_good_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 or h == "ok" else "short", h) for h in ("ok", "bad") for i in range(100)]
    docs = spark.createDataFrame([(i, t, h) for i, (_, t, h) in enumerate(rows)], "doc_id long, text string, source string")
    kept = quality.keep_good(docs)
    assert {r["source"] for r in kept.collect()} == {"ok"} and kept.count() == 100


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["low"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 130)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_against_all_pairs(odd, none):
    texts = [r[1] for r in odd_rows()]
    root = brute.simhash_roots(texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    for i, t in enumerate(texts):
        assert got[i]["fp"] & (1 << 64) - 1 == brute.fingerprint(t)
        assert got[i]["component_id"] == root[i]
    stay = simhash.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(root))
    assert simhash.near_duplicates(none).collect() == [] and simhash.drop_near_duplicates(none).collect() == []


def test_simhash_links_at_exactly_three_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = [b ^ sum(1 << k for k in rng.sample(range(63), n)) for b in base for n in (0, 2, 3, 4)]
    prints = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    got = {(r["low"], r["high"]) for r in simhash.links(prints).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_repeated_rows_and_null_ids_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()))) == ["1", "None"]


@pytest.mark.parametrize("hot", [substring.HOT, 3])
def test_substring_removal_against_brute_force(odd, hot):
    made, name = substring.deduplicate(odd, hot=hot)
    assert made.columns == [*odd.columns, name]
    got = {r["doc_id"]: r for r in made.collect()}
    rows = odd_rows()
    for row, (w, gone) in zip(rows, brute.kept_words([r[1] for r in rows]), strict=True):
        r = got[row[0]][name]
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), brute.sha(kept))
        assert r["kept"] == (" ".join(kept) if any(gone) else row[1] or "")


def test_substring_of_empty_and_repeated_rows(spark, none):
    assert substring.drop_repeats(none).collect() == []
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(2, text), (2, text), (None, "x " + text), (1, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["text"]) for r in substring.drop_repeats(docs).collect()}
    # Null comes first and keeps its words; both rows of 2 lose theirs.
    assert rows == {(2, ""), (None, "x " + text), (1, "")}


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        known = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        query = [rng.choice("abcd") for _ in range(15)]
        joined = ["".join(k) for k in known]
        for i, n in enumerate(automaton.matching(query)):
            ends = [m for m in range(i + 2) if any("".join(query[i + 1 - m : i + 1]) in k for k in joined)]
            assert n == max(ends)


def test_tiling_against_its_definition():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(4, 30))]
        cut = rng.randrange(len(item))
        doc = [rng.choice("abcdefgh") * 2 for _ in range(20)] + item[cut:] + ["zz"] + item[:cut]
        items = decontaminate.TestItems([1], [" ".join(item)], 3)
        words = decontaminate.folded_words(pa.array([" ".join(doc)]))
        parts = decontaminate.tiles(items.matches(words)[:, 2:], len(item), 3)
        assert sum(n for n, _, _ in parts) == brute.tiling(doc, item, 3)


def test_matches_are_the_longest_equal_runs():
    rng = random.Random(6)
    for _ in range(100):
        docs, tests = ([[rng.choice("ab") for _ in range(rng.randrange(0, 14))] for _ in range(3)] for _ in range(2))
        items = decontaminate.TestItems([0, 1, 2], [" ".join(t) for t in tests], 3)
        met = items.matches(decontaminate.folded_words(pa.array([" ".join(d) for d in docs])))
        starts = np.cumsum([0] + [len(d) for d in docs])
        got = sorted((d, i, p - starts[d], q - items.starts[i], n) for d, i, p, q, n in met.tolist())
        want = []
        for d, doc in enumerate(docs):
            for i, test in enumerate(tests):
                for p in range(len(doc)):
                    for q in range(len(test)):
                        n = 0
                        while p + n < len(doc) and q + n < len(test) and doc[p + n] == test[q + n]:
                            n += 1
                        inner = p and q and doc[p - 1] == test[q - 1]
                        if not inner and n >= min(3, len(test)):
                            want.append((d, i, p, q, n))
        whole = [w for w in want if len(tests[w[1]]) >= 3 or w[4] == len(tests[w[1]])]
        short = {w for w in got if len(tests[w[1]]) < 3}
        assert sorted(w for w in whole if len(tests[w[1]]) >= 3) == [g for g in got if g not in short]
        # An item shorter than a tile is found wherever it stands as a whole.
        assert short == {
            (d, i, p, 0, len(t)) for d, doc in enumerate(docs) for i, t in enumerate(tests)
            for p in range(len(doc)) if 0 < len(t) < 3 and doc[p : p + len(t)] == t
        }


def test_repeated_words_do_not_make_all_pairs():
    items = decontaminate.TestItems([1], ["w " * 1000], 5)
    words = decontaminate.folded_words(pa.array(["w " * 100_000]))
    assert len(items.matches(words)) == 100_000 - 4 + 1000 - 4 - 1
    tracemalloc.start()
    assert decontaminate.findings(words, items, 0.5) == [(0, 0, 1, 1000, 1000)]
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_decontamination_catches_reordered_passages(spark, odd, none):
    item = " ".join(f"t{i}" for i in range(30))
    w = item.split()
    swapped = " ".join(["before"] + w[15:] + ["between"] + w[:15])
    part = " ".join(w[:10]) + " and no more"
    docs = spark.createDataFrame(
        [(1, "x " + item.upper() + " y"), (2, swapped), (3, part), (4, None), (5, ""), (1, item)], "doc_id long, text string"
    )
    tests = spark.createDataFrame([(7, item), (8, None), (9, "t1 t2"), (10, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in decontaminate.contaminated(docs, tests).collect())
    # "t1 t2" is shorter than a tile and counts where it stands as a whole; null and empty items never do.
    assert got == [(1, 7, 30), (1, 7, 30), (1, 9, 2), (1, 9, 2), (2, 7, 30), (2, 9, 2), (3, 9, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, tests).collect()) == [4, 5]
    long = tests.where("item_id <> 9")
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, long).collect()) == [3, 4, 5]
    assert decontaminate.drop_contaminated(odd, tests).columns == odd.columns
    assert decontaminate.contaminated(none, tests).collect() == []
    assert decontaminate.contaminated(docs, tests.where("item_id < 0")).collect() == []


def test_test_items_in_several_blocks_give_the_same(spark):
    docs, tests = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontaminate.contaminated(docs, tests).collect())
    assert sum(1 for _ in decontaminate.test_blocks(tests, "item_id", "text", 5, 2000)) > 3
    assert sorted(decontaminate.contaminated(docs, tests, limit=2000).collect()) == whole
    dirty = {r["doc_id"] for r in whole}
    odd_rows = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    for limit in (2000, decontaminate.BLOCK_BYTES):
        kept = decontaminate.drop_contaminated(odd_rows, tests, limit=limit)
        assert kept.columns == docs.columns and kept.count() == docs.count() - len(dirty) + 3
        assert not dirty & {r["doc_id"] for r in kept.where("text IS NOT NULL").collect()}


def test_packing_is_best_fit_without_conflicts(odd, none):
    docs = [{"doc_id": r[0], "text": r[1], "source": r[3]} for r in odd_rows()]
    made = packing.pack(odd.coalesce(1).sortWithinPartitions("doc_id"), capacity=256)
    brute.check_packing([r.asDict() for r in made.collect()], docs, 256)
    assert packing.pack(none).collect() == []


def test_near_copies_of_different_sources_share_no_bin(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        copies = [list(words) for _ in range(4)]
        for i, c in enumerate(copies[1:]):
            c[-1] = f"changed{i}"
        rows += [(len(rows) + i, " ".join(c), f"s{(k + i) % 9}-{k}-{i}") for i, c in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(set(group.values())) == 6

    def shared(near: bool) -> int:
        bins: dict[int, list[int]] = {}
        for r in packing.pack(docs, near=near).collect():
            bins.setdefault(r["bin_id"], []).append(group[r["doc_id"]])
        assert sum(map(len, bins.values())) == len(rows)
        return sum(len(b) - len(set(b)) for b in bins.values())

    assert shared(True) == 0 and shared(False) > 0


def test_packing_in_shards_keeps_all_rows(odd):
    made = packing.pack(odd, capacity=256, shard=10)
    total = made.groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in total} == {r[0]: len(brute.words(r[1])) + 1 for r in odd_rows()}
    assert made.groupBy("bin_id").agg(F.sum("size").alias("n")).where("n > 256").count() == 0


def test_bins_take_the_tightest_compatible_one():
    bins = packing.Bins(10)
    assert [bins.put(6, 1, 0), bins.put(7, 1, 0), bins.put(8, 2, 4)] == [0, 1, 2]
    assert bins.put(2, 2, 0) == 1  # room 2 has the source, so room 3 takes it
    assert bins.put(2, 8, 4) == 0  # room 2 has the cluster, room 1 is too small
    assert bins.put(2, 8, 0) == 2


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    failed = [brute.rule_failed(brute.counts(r["text"])) for r in rows]
    hosts = brute.bad_hosts([(r["source"], f) for r, f in zip(rows, failed, strict=True)])
    rows = [r for r, f in zip(rows, failed, strict=True) if not f and r["source"] not in hosts]
    root = brute.simhash_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    for r, (w, gone) in zip(rows, brute.kept_words([r["text"] for r in rows]), strict=True):
        if any(gone):
            r["text"] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            r["n_chars"] = len(r["text"])
    rows = [r for r in rows if not any(brute.contaminated(r["text"], t) for t in items)]

    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SMALL)
        assert current.columns == docs.columns
    got = sorted((r.asDict() for r in current.collect()), key=lambda r: r["doc_id"])
    assert got == rows
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}
    assert sum(r["size"] for r in packed) == sum(len(brute.words(r["text"])) + 1 for r in rows)
