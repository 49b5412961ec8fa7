"""Lookups over their layouts against lookups over all symbols, and what their scans read."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cartograph.functions.text import next_prefix
from cartograph.operators import lookup
from cartograph.schema import SYMBOLS
from cartograph.sources import search

NAMES = ["get_item", "GETTER", "getXitem", "back\\slash", "percent%sign", "É", "é", "plain", "ab", "", "getget",
         "naïve_get", "😀get😀x", "a_b_c", "under_score"]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def symbols(spark):
    rnd = random.Random(7)
    words = NAMES + ["".join(rnd.choice("abgGeEtT_%") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    folders = ["src/a", "SRC/a", "src/b", "src2", "lib/ü", "s_c"]
    rows = [
        (f"{i:05d}", rnd.choice(words), rnd.choice(["function", "class"]), f"{rnd.choice(folders)}/m{i % 9}.py",
         i, i + 1, None, None, "null")
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, SYMBOLS)


@pytest.fixture(scope="module")
def lookups(spark, symbols, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups")) + "/p"
    search.write_lookups(symbols, path)
    return search.open_lookups(spark, path)


@pytest.mark.parametrize("kind", [None, "class"])
@pytest.mark.parametrize(
    "query", ["get", "GET_ITEM", "\\sl", "t%sign", "é", "a_b", "", "%", "get%get", "ab_get", "nothere", "😀get", "eTt%T"]
)
def test_postings_find_what_a_scan_finds(symbols, lookups, query, kind):
    want = lookup.search_symbol(symbols, query, kind, fuzzy=True, limit=40).collect()
    assert lookup.search_fuzzy(lookups, query, kind, limit=40).collect() == want


def test_more_names_than_literals(symbols, lookups):
    want = lookup.search_symbol(symbols, "get", fuzzy=True, limit=5000).collect()
    assert len(want) > 40 and lookup.search_fuzzy(lookups, "get", limit=5000).collect() == want


def test_grams_of_patterns():
    assert search.plain_grams("ab%cd_ef") == []
    assert search.plain_grams("ABCd_xyz") == ["abc", "bcd", "xyz"]


def test_pattern_reads_the_rarest_gram_only(lookups):
    counts = {r.gram: r.n for r in lookups.grams.collect()}
    assert counts["get"] > counts["ite"]
    real = lookups.postings.groupBy("gram").agg(F.count("*").alias("n")).collect()
    assert counts == {r.gram: r.n for r in real}
    found = lookup.search_fuzzy(lookups, "get%item")
    assert {r.name for r in found.collect()} == {"get_item", "getXitem"}
    assert "postings" not in plan(found)


@pytest.mark.parametrize("prefix", ["src", "src/", "src/a", "SRC/A/m1", "s_c", "%/m3", "", "lib/ü", "none"])
def test_folded_range_is_the_prefix(symbols, lookups, prefix):
    want = lookup.architecture_rows(symbols, prefix).collect()
    assert lookup.architecture_rows(lookups.by_path, prefix).collect() == want


def test_ends_of_ranges():
    assert next_prefix("src/a") == "src/b" and next_prefix("") is None
    assert next_prefix("\ud7ff") == "\ue000"
    assert next_prefix("a\U0010ffff") == "b" and next_prefix("\U0010ffff") is None


def test_literals_reach_the_scans_and_skip_files(spark, symbols, tmp_path):
    # So small a table would otherwise be merged to one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lookups = search.write_lookups(symbols, str(tmp_path / "spread"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = lookup.get_symbol(lookups.by_id, "00123")
    assert one.count() == 1 and "EqualTo(id,00123)" in plan(one)
    inside = lookup.under_path(lookups.by_path, "src/b/")
    assert "GreaterThanOrEqual(folded_path,src/b)" in plan(inside) and "LessThan(folded_path,src/c)" in plan(inside)

    def groups(frame, column):
        for name in frame.inputFiles():
            meta = pq.ParquetFile(name.removeprefix("file:").replace("///", "/")).metadata
            at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
            for g in range(meta.num_row_groups):
                yield meta.row_group(g).column(at).statistics

    ids = list(groups(lookups.by_id, "id"))
    assert len(ids) > 1 and sum(s.min <= "00123" <= s.max for s in ids) == 1
    paths = list(groups(lookups.by_path, "folded_path"))
    assert 0 < sum(s.max >= "src/b" and s.min < "src/c" for s in paths) < len(paths)
