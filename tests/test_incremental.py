"""The bucketed store: every version equals a full index, and writes only what its change touches."""

from __future__ import annotations

import random

import pytest

from cartograph.plans import incremental, index
from cartograph.session import new_path
from cartograph.sources import buckets

VERSIONS = "path string, content string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def same_as_full(spark, held, files):
    """All tables of a version against a full index of the present files."""
    got = incremental.as_index(held)
    want = index.index_sources(spark.createDataFrame(sorted(files.items()), VERSIONS), new_path(spark, "full"))
    assert rows(got.symbols) == rows(want.symbols) == rows(got.symbols_by_name)
    assert rows(got.edges) == rows(want.edges) == rows(got.edges_by_target)
    assert rows(got.raw_edges) == rows(want.raw_edges.distinct())
    present = got.files.where("NOT deleted")
    assert rows(present.select("path")) == rows(want.files.select("path"))
    keyed = [{r.key: r.value for r in x.meta.collect() if r.key != "indexed_at"} for x in (got, want)]
    assert keyed[0] == keyed[1]


def python_file(rng, n):
    """Functions from a small pool of names, so that many files share and call them."""
    text = ""
    for _ in range(rng.randint(0, n)):
        calls = "".join(f"    f{rng.randint(0, 9)}()\n" for _ in range(rng.randint(0, 2)))
        text += f"def f{rng.randint(0, 9)}():\n{calls or '    pass\n'}"
    return text


def test_versions_equal_full_indexes(spark):
    rng = random.Random(4)
    files = {f"{folder}/m{i}.py": python_file(rng, 4) for folder in ("a", "b") for i in range(6)}
    files["a/c.py"] = "class K:\n    def go(self):\n        f1()\n"
    base = new_path(spark, "versions")
    held = incremental.create(spark, spark.createDataFrame(sorted(files.items()), VERSIONS), base, n_buckets=8)
    same_as_full(spark, held, files)

    change = {"a/m0.py": python_file(rng, 4), "a/m1.py": None, "b/new.py": "def f1():\n    go()\n", "a/c.py": "x = 1\n"}
    held = incremental.replace_paths(held, spark.createDataFrame(sorted(change.items()), VERSIONS))
    files = {p: t for p, t in (files | change).items() if t is not None}
    same_as_full(spark, held, files)

    now = {"a/m2.py": "def f0():\n    f3()\n", "a/m9.py": "def f3(): pass\n", "b/no.py": "def no(): pass\n"}
    held = incremental.replace_scope(held, spark.createDataFrame(sorted(now.items()), VERSIONS), "a")
    files = {p: t for p, t in files.items() if not p.startswith("a/")} | {p: t for p, t in now.items() if p != "b/no.py"}
    same_as_full(spark, held, files)
    # Each version can still be read from its manifest, and one that was never written cannot.
    again = buckets.load(spark, base, held.version)
    assert again == held and buckets.load(spark, base, 0).version == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        buckets.load(spark, base, 9)


def test_one_file_changes_only_its_buckets(spark):
    files = {f"m{i}.py": f"def own{i}():\n    own{(i + 1) % 40}()\n    shared()\n" for i in range(40)}
    files["z.py"] = "def shared(): pass\n"
    sources = spark.createDataFrame(sorted(files.items()), VERSIONS)
    before = incremental.create(spark, sources, new_path(spark, "versions"))
    change = {"m7.py": "def own7():\n    own9()\n"}
    after = incremental.replace_paths(before, spark.createDataFrame(list(change.items()), VERSIONS))
    same_as_full(spark, after, files | change)

    def rewritten(table):
        return {b for b, (v, _) in after.held[table].items() if v == after.version}

    mine = after.dirty("files", spark.createDataFrame([("m7.py",)], "path string"))
    assert len(mine) == 1
    for table in ("files", "symbols", "raw_edges", "edges_by_source"):
        assert rewritten(table) == mine
    assert len(rewritten("symbols_by_name")) == 1
    # Edges to own8 and shared went, one to own9 came.
    assert 1 <= len(rewritten("edges_by_target")) <= 3
    assert all(len(after.held[t]) > 15 for t in ("symbols", "raw_edges", "edges_by_source"))

    # A new first symbol of a popular name moves the edges of all callers, and no symbols of theirs.
    moved = incremental.replace_paths(after, spark.createDataFrame([("a.py", "def shared(): pass\n")], VERSIONS))
    same_as_full(spark, moved, files | change | {"a.py": "def shared(): pass\n"})
    assert sum(v == moved.version for v, _ in moved.held["symbols"].values()) == 1
    assert sum(v == moved.version for v, _ in moved.held["edges_by_source"].values()) > 15


def test_empty_changes_and_empty_stores(spark):
    none = spark.createDataFrame([], VERSIONS)
    held = incremental.create(spark, none, new_path(spark, "versions"))
    assert rows(incremental.as_index(held).symbols) == []
    held = incremental.replace_paths(held, spark.createDataFrame([("a.py", "def a(): a()\n")], VERSIONS))
    same = incremental.replace_paths(held, none)
    assert {t: h for t, h in same.held.items()} == {t: h for t, h in held.held.items()}
    gone = incremental.replace_paths(same, spark.createDataFrame([("a.py", None)], VERSIONS))
    got = incremental.as_index(gone)
    assert rows(got.symbols) == rows(got.edges) == [] and rows(got.files) == [("a.py", None, True)]
