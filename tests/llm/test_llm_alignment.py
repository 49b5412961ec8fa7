"""Cross-tokenizer alignment against all pairs of tokens."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers

from cartograph.llm import alignment, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, pair long, slice string, groups string"
ODD = [
    None, "", " ", "\n", "a", " lead", "two  spaces   here ", "tabs\tand\r\nlines\n\n", "<|endoftext|> </s> <s> <unk> <0x41>",
    "漢字かな交じり文です", "مرحبا بالعالم", "😀👍🏽 emoji 👨‍👩‍👧", "naïve café — “quotes”", "▁ piece mark", " nbsp 　wide",
    "é combining", "a\x00b", "x" * 3000, "don't can't I'll", "1234567 3.14159", "the cat sat on the mat " * 200,
    "antidisestablishmentarianism " * 3,
]


@pytest.fixture(scope="module")
def known():
    return alignment.Tokenizers(alignment.FOLDER)


def plain_alignment(texts, known):
    """Every pair of tokens with overlapping bytes, straight from the definition."""
    def spans(ids, side):
        ends = np.cumsum([len(side.pieces[i]) for i in ids])
        return list(zip([0, *ends[:-1]], ends, strict=True))

    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        ((a, b),) = known.encode([text])
        whole = (" " + text).encode()
        if b"".join(known.a.pieces[i] for i in a) != whole or b"".join(known.b.pieces[i] for i in b) != whole:
            docs.append(None)
            continue
        sa, sb = spans(a, known.a), spans(b, known.b)
        shared = {e for _, e in sa} & {e for _, e in sb}
        links = [(a[i], b[j]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(x, u) < min(y, v)]
        parts, low = [], 0
        for cut in sorted(shared):
            ids = [[t for t, (x, y) in zip(side, at, strict=True) if low <= x and y <= cut] for side, at in ((a, sa), (b, sb))]
            parts.append("|".join(",".join(map(str, p)) for p in ids))
            low = cut
        counts.update(links)
        docs.append((a, b, parts, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, parts, links = d
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        hits = sum(counts[x] == best[x[1]] for x in links)
        rows.append((len(a), len(b), len(parts), len(links), hits, sum(counts[x] for x in links), digest))
    return rows, counts


def compare(spark, texts, known, parts):
    docs = spark.createDataFrame([(i, t, 1, "s", "g") for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    found, pairs = alignment.align_documents(docs)
    rows, counts = plain_alignment(texts, known)
    assert sorted(tuple(r) for r in found.collect()) == [(i, *r) for i, r in enumerate(rows)]
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == counts
    return rows


def test_odd_texts(spark, known):
    rows = compare(spark, [*ODD, *ODD[3:9], ODD[-2]], known, 3)
    # Most of them are aligned, and some have groups of several tokens.
    assert sum(r[0] > 0 for r in rows) > len(ODD) - 6
    assert any(r[2] < min(r[0], r[1]) for r in rows)


def test_documents_in_many_slices(spark, known, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = [t[:600] for t in texts[:60]] + texts[:5] * 3
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    compare(spark, texts, known, 6)


def test_parts_of_a_slice_do_not_change_results(spark, known, monkeypatch):
    texts = [r["text"][:2000] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()[:40]]
    times = np.ones(len(texts), np.int64)
    whole = alignment.align_slice(texts, times, known, True)
    monkeypatch.setattr(alignment, "ENCODE_BYTES", 10)
    again = alignment.align_slice(texts, times, known, True)
    assert all(np.array_equal(whole[c], again[c]) for c in whole)
    assert [hashlib.sha256(g.encode()).hexdigest() for g in whole["groups"]] == whole["groups_sha256"]


def test_ids_are_those_of_the_tokenizer_file(spark, known):
    """The fast encoder against the library that the file was written for, on every character."""
    own = tokenizers.Tokenizer.from_file(os.path.join(alignment.FOLDER, alignment.FILE_A))
    own.encode_special_tokens = True
    texts = [t for t in ODD if t] + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    marks = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(marks), 4000):
        texts.append("".join(f"a{c} {c}{c}1{c}\n" for c in marks[at : at + 4000]))
    theirs = own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    for text, t in zip(texts, theirs, strict=True):
        assert known._a.encode_ordinary(" " + text) == t.ids, text[:50]


def test_windows_split_at_anchors(known):
    text = "the quick brown fox"
    ((a, b),) = known.encode([text])
    starts, first_a, first_b = alignment.windows(np.array(a), np.array(b), known.a, known.b, np.array([0]))
    assert len(starts) == 4
    assert all(known.a.pieces[a[i]].startswith(b" ") and known.b.pieces[b[j]].startswith(b" ") for i, j in zip(first_a, first_b, strict=True))


def test_groups_empty_tables_and_null_ids(spark, known):
    none = spark.createDataFrame([], SCHEMA)
    found, pairs = alignment.align_documents(none)
    assert found.collect() == [] and pairs.collect() == []
    docs = spark.createDataFrame([(None, "of the time", 1, "", ""), (None, "of the time", 1, "", ""), (1, None, 1, "", "")], SCHEMA)
    rows = alignment.align_documents(docs, groups=True)[0].collect()
    assert sorted(r["n_a"] for r in rows) == [0, 3, 3]
    assert {r["groups"] for r in rows if r["n_a"]} == {plain_groups("of the time", known)}
    assert {(r["groups"], r["groups_sha256"]) for r in rows if not r["n_a"]} == {("", "")}


def plain_groups(text, known):
    ((a, b),) = known.encode([text])
    return ";".join(f"{x}|{y}" for x, y in zip(a, b, strict=True))


def test_query_covers_all_documents(spark):
    rows = queries.op13_tokenizer_alignment(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert (rows.n_links == rows.n_a + rows.n_b - rows.n_groups).all()
    assert (rows.n_a > 0).mean() > 0.9 and (rows.n_best <= rows.n_links).all()
    assert os.path.isdir(alignment.FOLDER)
