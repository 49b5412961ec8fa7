"""Directories, ignore files, the store, reindexing and the stream, on temporary copies."""

import pytest
from pyspark.sql import functions as F

from cartograph.plans import index
from cartograph.session import new_path, shared_dir, stage
from cartograph.sources import discovery, store
from cartograph.streaming import reindex

FILES = {
    "src/app.py": b"def main():\n    helper()\n",
    "src/__init__.py": b"",
    "src/lib.py": b"def helper():\n    pass\n",
    "src/core/a.go": b"package a\n\nfunc A() { B() }\n\nfunc B() {}\n",
    "src/co/x.rs": b"fn x() {}\n",
    "node_modules/pkg/i.js": b"function skipped() {}\n",
    ".hidden/h.py": b"def hidden(): pass\n",
    "gen/out.py": b"def generated(): pass\n",
    "gen/keep.py": b"def kept(): pass\n",
    "build2/deep/b.ts": b"function ignored() {}\n",
    "src/bad.py": b"def bad():\n    '\xff\xfe'\n",
    "src/readme.md": b"# no\n",
    "src/UPPER.PY": b"def upper(): pass\n",
    ".gitignore": b"# rules\nbuild2/\ngen/*.py\n!gen/keep.py\n",
}


@pytest.fixture()
def project(tmp_path):
    for name, data in FILES.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "p")


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_discover(spark, project):
    found = {r.path for r in discovery.discover(spark, project).collect()}
    assert found == {
        "src/__init__.py", "src/app.py", "src/lib.py", "src/core/a.go", "src/co/x.rs", "src/bad.py", "gen/out.py",
        "gen/keep.py", "build2/deep/b.ts",
    }
    assert {r.path for r in discovery.discover(spark, project, "src/co").collect()} == {"src/co/x.rs"}
    assert {r.path for r in discovery.discover(spark, project, project + "/src/core/").collect()} == {"src/core/a.go"}
    every = discovery.discover(spark, project, skip_dirs=False, hidden=True)
    assert {"node_modules/pkg/i.js", ".hidden/h.py"} <= {r.path for r in every.collect()}


def test_index_directory(spark, project, tmp_path):
    built, bad = index.index_directory(spark, project, str(tmp_path / "out"))
    assert ids(built.symbols) == [
        "gen/keep.py::kept", "src/app.py::main", "src/co/x.rs::x", "src/core/a.go::A",
        "src/core/a.go::B", "src/lib.py::helper",
    ]
    assert sorted((r.source_id, r.target_id) for r in built.edges.collect()) == [
        ("src/app.py::main", "src/lib.py::helper"), ("src/core/a.go::A", "src/core/a.go::B")]
    assert [(r.path, r.reason) for r in bad.collect()] == [("src/bad.py", "not UTF-8")]
    meta = {r.key: r.value for r in built.meta.collect()}
    assert meta["file_count"] == "7" and meta["symbol_count"] == "6" and meta["schema_version"] == "1"
    assert built.edges.collect() and sorted(built.edges.collect()) == sorted(built.edges_by_target.collect())


def test_reindex_scope_keeps_the_rest(spark, project, tmp_path):
    built, _ = index.index_directory(spark, project, str(tmp_path / "one"))
    changed = spark.createDataFrame(
        [("src/lib.py", "def renamed():\n    main()\n"), ("elsewhere.py", "def no(): pass\n")],
        "path string, content string",
    )
    again = index.reindex_scope(built, changed, "src/lib.py", str(tmp_path / "two"))
    assert "src/lib.py::renamed" in ids(again.symbols) and "src/lib.py::helper" not in ids(again.symbols)
    assert "elsewhere.py::no" not in ids(again.symbols)
    assert ("src/lib.py::renamed", "src/app.py::main") in {(r.source_id, r.target_id) for r in again.edges.collect()}
    # The call to helper no longer resolves, and does again when the name comes back elsewhere.
    assert not any(r.source_id == "src/app.py::main" for r in again.edges.collect())
    back = spark.createDataFrame([("new.py", "def helper(): pass\n")], "path string, content string")
    third = index.reindex_paths(again, back, str(tmp_path / "three"))
    assert ("src/app.py::main", "new.py::helper") in {(r.source_id, r.target_id) for r in third.edges.collect()}


def test_stream_equals_batch_and_replays(spark, tmp_path):
    versions, base, mark = (str(tmp_path / x) for x in ("versions", "base", "mark"))
    first = [("a.py", "def a():\n    b()\n", 1), ("b.py", "def b(): pass\n", 1)]
    second = [("b.py", "def old(): pass\n", 2), ("b.py", "def b():\n    a()\n", 3)]
    for rows in (first, second):
        spark.createDataFrame(rows, reindex.VERSIONS).coalesce(1).write.mode("append").parquet(versions)
        reindex.start(spark, versions, base, mark).awaitTermination()
    last = reindex.latest(spark, base)
    batch = index.index_sources(
        index.newest_sources(spark.createDataFrame(first + second, reindex.VERSIONS)), str(tmp_path / "batch"))
    assert ids(last.symbols) == ids(batch.symbols) == ["a.py::a", "b.py::b"]
    assert sorted(last.edges.collect()) == sorted(batch.edges.collect())
    # A batch that runs again, as after a crash before its commit, writes the same version.
    reindex.apply_batch(base)(spark.createDataFrame(second, reindex.VERSIONS), 1)
    assert sorted(reindex.latest(spark, base).edges.collect()) == sorted(batch.edges.collect())


def test_stream_keeps_the_newest_version_and_deletes(spark, tmp_path):
    base = str(tmp_path / "base")

    def arrive(batch_id, *rows):
        reindex.apply_batch(base)(spark.createDataFrame(rows, reindex.VERSIONS), batch_id)
        return ids(reindex.latest(spark, base).symbols)

    assert arrive(0, ("a.py", "def a(): pass\n", 5), ("b.py", "def b(): pass\n", 5)) == ["a.py::a", "b.py::b"]
    assert arrive(1, ("a.py", "def old(): pass\n", 1)) == ["a.py::a", "b.py::b"]
    assert arrive(2, ("b.py", None, 6), ("a.py", "x = 1\n", 6)) == []
    assert arrive(3, ("b.py", "def late(): pass\n", 5)) == []
    meta = {r.key: r.value for r in reindex.latest(spark, base).meta.collect()}
    # A file without declarations counts, a deleted one does not.
    assert (meta["file_count"], meta["symbol_count"]) == ("1", "0")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        arrive(7, ("c.py", "def c(): pass\n", 1))


def test_ignore_rules(spark):
    lines = [
        ("", 0, "*.log.py"), ("", 1, "/top.py"), ("", 2, "docs/**/gen"), ("", 3, "!keep.log.py"),
        ("sub", 0, "x?.py"), ("", 4, "dirs/"), ("", 5, "!dirs/inside.py"), ("", 6, "a/**"), ("", 7, "**/deep.py"),
    ]
    rules = discovery.parse_ignore_rules(spark.createDataFrame(lines, "dir string, line_no int, line string"))
    paths = {
        "m.log.py": False, "keep.log.py": True, "top.py": False, "n/top.py": True, "docs/gen/a.py": False,
        "docs/x/y/gen/a.py": False, "docs/x/a.py": True, "sub/x1.py": False, "x1.py": True, "sub/x12.py": True,
        "dirs/inside.py": False, "q/dirs/z.py": False, "a/b.py": False, "a.py": True, "p/q/deep.py": False,
    }
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path for r in discovery.drop_ignored(files, rules).collect()}
    assert kept == {p for p, keep in paths.items() if keep}


def test_ignore_classes_escapes_and_malformed_lines(spark):
    lines = [("", 0, "[!a]x.py"), ("", 1, r"w\*.py"), ("", 2, "foo[bar"), ("", 3, "r[a-c]z.py"), ("", 4, "s[z-a].py"),
             ("", 5, "t[]q].py"), ("", 6, r"\#h.py"), ("", 7, r"e[\]b].py"), ("", 8, "end\\"), ("", 9, "u[&&[].py")]
    frame = spark.createDataFrame(lines, "dir string, line_no int, line string")
    assert {r.line for r in discovery.malformed_rules(frame).collect()} == {"foo[bar", "s[z-a].py", "end\\"}
    paths = {
        "ax.py": True, "bx.py": False, "d/ax.py": True, "w*.py": False, "wz.py": True, "foo[bar": True, "rbz.py": False,
        "rdz.py": True, "sz.py": True, "t].py": False, "tq.py": False, "#h.py": False, "e].py": False, "eb.py": False,
        "ec.py": True, "u&.py": False, "u[.py": False, "uz.py": True,
    }
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path for r in discovery.drop_ignored(files, discovery.parse_ignore_rules(frame)).collect()}
    assert kept == {p for p, keep in paths.items() if keep}


def test_entries_of_the_listing_are_not_broadcast_to_meet_the_rules(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([("", 0, "x*.py"), ("a", 0, "!b/x1.py"), ("a/b", 0, "y.py")], "dir string, line_no int, line string")
    paths = [f"a/b/x{i}.py" for i in range(20)] + ["a/y.py", "a/b/y.py"]
    spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))

    def joins(kept):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Join" in line and "[dir#" in line]

    few = discovery.drop_ignored(files, discovery.parse_ignore_rules(lines))
    assert all("BroadcastHashJoin" in j and "BuildRight" in j for j in joins(few)) and joins(few)
    monkeypatch.setattr(discovery, "FEW_RULES", 2)
    many = discovery.drop_ignored(files, discovery.parse_ignore_rules(lines))
    assert all("SortMergeJoin" in j for j in joins(many)) and joins(many)
    for kept in (few, many):
        assert sorted(r.path for r in kept.collect()) == ["a/b/x1.py", "a/y.py"]


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"def a(): pass\n")
    (tmp_path / "gone.py").write_bytes(b"x")
    files = stage(discovery.walk(spark, str(tmp_path)), "files").df
    (tmp_path / "gone.py").unlink()
    good, bad = discovery.read_sources(str(tmp_path), files)
    assert [r.path for r in good.collect()] == ["a.py"]
    assert [(r.path, r.reason) for r in bad.collect()] == [("gone.py", "vanished")]


def test_many_small_files_are_read_by_more_than_one_task(spark):
    files = spark.range(5000).select(F.format_string("f%d.py", "id").alias("path"), F.lit("/none").alias("full_path"), F.lit(10).alias("length"))
    assert discovery.read_bytes("/", files).rdd.getNumPartitions() > 8


def test_stage_counts_and_uses_the_named_folder(spark):
    staged = stage(spark.range(10).toDF("n"), "t")
    assert staged.rows == 10 and staged.df.count() == 10
    assert new_path(spark, "x").startswith(shared_dir(spark))
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named is None or shared_dir(spark) == named.rstrip("/")
