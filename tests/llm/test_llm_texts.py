"""Language ID, language-model scores, license scans, chat formatting and HTML extraction."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartograph.llm import brown, chat, html, langid, license, queries

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n ", "1 2 3 ...", "the", "x" * 50_000, "All rights reserved. " * 3, "é ß 漢字 ñ"]
SCHEMA = "doc_id long, text string, lang string, source string, held_out int, score string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", "s", 1, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_of_held_out_documents(spark):
    found = queries.op2_language_id(spark, SMALL).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id")
    assert list(found.index.sort_values()) == list(truth.index.sort_values())
    fold = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.index]
    assert list(found.held_out) == fold
    held = found[found.held_out]
    assert (held.lang_pred == truth.lang.loc[held.index]).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_of_odd_texts(odd, none):
    rows = langid.identify(odd, F.lit(True)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 1
    assert [got[i]["lang_pred"] for i in range(len(ODD))] == ["und"] * 4 + ["en"] * 4
    assert all(got[i]["score"] == 0 and not got[i]["accepted"] for i in range(4))
    unlearned = langid.identify(odd, F.lit(False)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert langid.identify(none, F.lit(True)).collect() == []


def test_prediction_reads_whole_texts(spark):
    texts = ["the of and that with " * 20, "der die das und nicht " * 20]
    model = langid.train(langid.bags(pa.array(texts * 20)), ["en", "de"] * 20)
    docs = spark.createDataFrame([(1, texts[0] + texts[1] * 60)], "doc_id long, text string")
    assert langid.predict(docs, model).first()["lang_pred"] == "de"


def test_sample_of_a_language_is_bounded(spark):
    docs = spark.range(3 * langid.SAMPLE).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang")
    )
    known, labels = langid.labelled_sample(docs.union(docs.limit(500)), "text", "lang", "doc_id")
    assert len(known) == langid.SAMPLE == len(labels)
    hashes = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").orderBy("h").limit(langid.SAMPLE)
    want = langid.bags(pa.array([r["text"] for r in hashes.collect()]))
    assert all((a.buckets == b.buckets).all() and (a.times == b.times).all() for a, b in zip(known, want, strict=True))
    # Whole texts teach, and what the driver gets of one is bounded.
    long = spark.createDataFrame([(1, "w " * 100_000, "en")], "doc_id long, text string, lang string")
    ((one,), _) = langid.labelled_sample(long, "text", "lang", "doc_id")
    assert one.size == 200_001 and len(one.buckets) < 10


def test_base_score_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    tokens = {i: [*brute.words(brute.fold(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.op4_lm_score(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"]) == (held[r["doc_id"]], len(ws))
        assert (r["n_known"], r["train_tokens"]) == (sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    # On texts it has not seen the class model does better than single words.
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_texts(odd, none):
    rows = {r["doc_id"]: r for r in brown.score(odd, F.lit(True)).collect()}
    assert [rows[i]["n_tokens"] for i in (0, 1, 2, 4)] == [1, 1, 1, 2]
    assert all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in rows.values())
    blank = brown.score(odd, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in blank} == {(0, 0)}
    assert brown.score(none, F.lit(True)).collect() == []


def test_words_beyond_the_vocabulary_count_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    learn = F.col("doc_id") % 3 != 0
    whole = {r["doc_id"]: r for r in brown.score(docs, learn).collect()}
    monkeypatch.setattr(brown, "TOP", brown.CLUSTERED)
    for r in brown.score(docs, learn).collect():
        other = whole[r["doc_id"]]
        assert r["n_known"] == other["n_known"]
        assert math.isclose(r["base_score"], other["base_score"], rel_tol=1e-9)
        assert math.isclose(r["score"], other["score"], rel_tol=1e-9)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    # Three hidden classes that follow each other in a ring.
    hidden = np.arange(30) % 3
    pairs = rng.poisson(1, (31, 31)).astype(float)
    pairs[:30, :30] += 20 * (hidden[None] == (hidden[:, None] + 1) % 3)
    order = rng.permutation(30)
    mixed = pairs.copy()
    mixed[:30, :30] = pairs[np.ix_(order, order)]
    kind = brown.exchange(mixed, 30, sweeps=20, classes=3)
    groups = {frozenset(np.flatnonzero(kind[:30] == k)) for k in range(3)}
    assert groups == {frozenset(np.flatnonzero(hidden[order] == k)) for k in range(3)}
    assert kind[30] == 3


def test_every_training_word_has_the_class_of_its_neighbours(spark):
    # Words of two kinds in turn, four times as many as the head has; names say nothing about the kind.
    rng = random.Random(6)
    names = rng.sample(range(100_000), 4 * brown.CLUSTERED)
    kinds = names[::2], names[1::2]
    common = ("aa", "ab", "ac"), ("ba", "bb", "bc")
    texts = [
        " ".join(rng.choice(common[k % 2]) if rng.random() < 0.7 else f"x{rng.choice(kinds[k % 2])}" for k in range(400))
        for _ in range(400)
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, words = brown.fit(docs)
    classes = {r["word"]: (r["kind"], r["n"]) for r in words.collect()}
    seen = Counter(w for t in texts for w in t.split())
    assert {w: n for w, (_, n) in classes.items()} == seen and len(seen) > 3 * brown.CLUSTERED
    # Words beyond the head share no class with words of the other kind.
    rest = [{classes[f"x{w}"][0] for w in k if 0 < seen[f"x{w}"] <= 2} for k in kinds]
    assert rest[0] and rest[1] and not rest[0] & rest[1]
    table = brown.class_bigrams(docs, model.known, words)
    want = Counter()
    for t in texts:
        kind = [brown.END_CLASS, *(classes[w][0] for w in t.split()), brown.END_CLASS]
        want.update(zip(kind, kind[1:]))
    assert {(int(a), int(b)): int(table[a, b]) for a, b in zip(*np.nonzero(table))} == dict(want)


@pytest.mark.parametrize("rows", [1, 2, 10_000])
def test_counts_of_a_word_are_summed_across_batches(spark, rows):
    rng = np.random.default_rng(3)
    width = 2 * brown.TOTAL
    entries, sums = [], {}
    for i in range(120):
        codes = np.sort(rng.choice(width, rng.integers(1, 9), replace=False))
        times = rng.integers(1, 5, len(codes))
        word = f"w{rng.integers(0, 12)}"
        entries.append((word, codes.tolist(), times.tolist()))
        np.add.at(sums.setdefault(word, np.zeros(width)), codes, times)
    table = rng.poisson(3, (brown.TOTAL, brown.TOTAL)).astype(float)
    found = spark.createDataFrame(entries, "word string, codes array<int>, times array<int>")
    found = found.repartition(3, "word").sortWithinPartitions("word")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {r["word"]: (r["n"], r["kind"]) for r in brown.assign(found, table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = sorted(sums)
    both = np.stack([sums[w].reshape(2, -1) for w in words])
    kind = brown.gains(table, both[:, 0], both[:, 1]).argmax(1)
    assert got == {w: (int(b[1].sum()), int(k)) for w, b, k in zip(words, both, kind, strict=True)}


def test_licenses(spark, odd, none):
    mit = license.TEMPLATES[4].text
    texts = [
        "Licensed under CC BY-NC 4.0.", "This is under the GNU General Public License, version 3.",
        "x " + mit.replace("copy of this", "copy of any of this") + " y", "all rights. reserved all rights are reserved",
        "Licensed under the Apache License, Version 2.0. " * 3, None, "cc by cc by",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(7)] == [
        "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "mit", "reserved", "apache-2.0", "", "cc-by"
    ]
    assert [got[i]["base_labels"] for i in range(7)] == ["cc-by", "gpl", "", "reserved", "", "", "cc-by"]
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 2)
    assert (got[5]["n_words"], got[5]["first_word"], got[5]["score"]) == (0, None, 0.0)
    assert 0.8 <= got[2]["score"] <= 1
    strange = license.scan(odd).collect()
    assert len(strange) == len(ODD) + 1 and {r["n_base"] for r in strange if r["doc_id"] == 6} == {3}
    assert license.scan(none).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the bsd license", ""),
        ("released under the foo license", ""),
        ("licensed under the mit license", "mit"),
        ("licensed under the gnu general public license", "gpl"),
        ("licensed under the gnu general public license version 1", "gpl"),
        ("licensed under the gnu lesser general public license version 3", "gpl,lgpl"),
        ("licensed under the apache license version 1.1", ""),
        ("this source code form is subject to the terms of the mozilla public license v 1.1", ""),
        (
            "Subject to the terms of the Common Development and Distribution License (the License). You may not use "
            "this file except in compliance with the License. You can obtain a copy of the license at",
            "cddl",
        ),
        (
            "Licensed under the Educational Community License, Version 2.0; you may not use this file except in "
            "compliance with the License. You may obtain a copy of the License at",
            "ecl-2.0",
        ),
        (
            "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
            "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "apache-2.0",
        ),
        (
            "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and "
            "without fee is hereby granted, provided that",
            "hpnd",
        ),
        (
            "ISC License\n\nCopyright (c) 2004\n\nPermission to use, copy, modify, and/or distribute this software for "
            "any purpose with or without fee is hereby granted",
            "isc",
        ),
        ("Available under CC BY 3.0.", "cc-by,cc-by-3.0"),
        ("CC BY-NC-SA", "cc-by,cc-by-nc-sa"),
        ("CC BY-NC-SA 2.5 or so", "cc-by,cc-by-nc-sa-2.5"),
        ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
        ("// SPDX-License-Identifier: BSL-1.0", "bsl-1.0"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ""),
    ],
)
def test_the_words_that_tell_a_license_are_needed(spark, text, labels):
    docs = spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string")
    assert license.scan(docs).first()["labels"] == labels


def test_places_of_phrases_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in license.scan(docs).collect()}
    for r in docs.collect():
        w = brute.ALNUM.findall(brute.fold(r["text"]))
        at = sorted(i for p in license.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(w), len(at))
        assert (g["first_word"], g["last_word"]) == ((at[0], at[-1]) if at else (None, None))


def _licenses_by_hand(words: list[str]) -> set[str]:
    """Labels by the definition: every template at every run of places, no hashes and no join."""
    shares = []
    for i, own in enumerate(license.template_words()):
        votes: dict[int, list[int]] = {}
        for at in range(len(words) - license.GRAM + 1):
            for place in range(len(own) - license.GRAM + 1):
                if words[at : at + license.GRAM] == own[place : place + license.GRAM]:
                    votes.setdefault(at - place, []).append(at)
        runs: list[list[int]] = []
        for diagonal in sorted(votes):
            if not runs or diagonal - runs[-1][0] > license.NEIGHBOUR:
                runs.append([diagonal])
            runs[-1][0] = diagonal
            runs[-1] += votes[diagonal]
        size = len(own)
        least = max(1, size - license.GRAM + 1 - license.GRAM * math.ceil((1 - license.AGREE) * size))
        for _, *at in runs:
            if len(at) >= least:
                span = {"template": i, "first": min(at), "last": max(at)}
                share = license.compare(words, span, license.TEMPLATES[i], own)
                if share >= license.AGREE:
                    shares.append((share, size, license.TEMPLATES[i].label, span))
    return {label for label, _ in license.best_of_place(shares)}


def test_labels_against_brute_force(spark):
    """Votes, spans and labels, on texts stitched from templates, their pieces and other words."""
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        words: list[str] = []
        for _ in range(rng.randint(1, 4)):
            piece = rng.choice(license.TEMPLATES).text.split()
            if rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = rng.choice(["sa", "x", "the", "2.0", "of the"])
            if rng.random() < 0.3:
                piece = piece[: rng.randint(1, len(piece))]
            words += piece + rng.choices(["foo", "bar", "apache", "license", "2"], k=rng.randint(0, 70))
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in license.scan(docs).collect():
        words = brute.ALNUM.findall(brute.fold(texts[r["doc_id"]]))
        assert r["labels"] == ",".join(sorted(_licenses_by_hand(words) | (set(r["base_labels"].split(",")) - {""})))


TURNS = "conv_id long, turn long, role string, text string, score string, node int"


def test_chat_round_trip_of_odd_turns(spark):
    rng = random.Random(9)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "|", "[", "\n", "x", "é"]
    rows = [(1, t, rng.choice(["user", "assistant", "<|im_sep|>"]), "".join(rng.choices(bits, k=12)), "x", 1) for t in range(70)]
    rows += [(2, 0, None, None, "x", 1), (None, 3, "user", "a", "x", 1), (None, 4, "assistant", "b", "x", 1), (2, 0, None, None, "x", 1)]
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    back = {r["conv"]: r for r in chat.read_back(chat.format_trees(chat.turn_chain(turns))).collect()}
    want = {1: [(r[2], r[3]) for r in rows[:70]], 2: [("", ""), ("", "")], None: [("user", "a"), ("assistant", "b")]}
    assert {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in back.items()} == want
    assert back[1]["loss_text"] == "".join(t for r, t in want[1] if r == "assistant")
    empty = chat.format_trees(chat.turn_chain(spark.createDataFrame([], TURNS)))
    assert chat.read_back(empty).collect() == []


def test_reply_trees_rank_their_branches(spark):
    rows = [
        (1, 10, None, 0.0, "user", "root"), (1, 11, 10, 1.0, "assistant", "good"), (1, 12, 10, 0.5, "assistant", "poor"),
        (1, 13, 11, 0.0, "user", "more"), (1, 14, 13, 0.2, "assistant", "end"), (1, 15, 13, 0.2, "assistant", "tie"),
        (2, 1, 99, 0.0, "user", "orphan"),
    ]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string")

    def texts(branches):
        made = chat.read_back(chat.format_trees(nodes, branches)).collect()
        return sorted((r["conv"], r["leaf"], [t["text"] for t in r["turns"]]) for r in made)

    assert texts(1) == [(1, 14, ["root", "good", "more", "end"]), (2, 1, ["orphan"])]
    assert [leaf for _, leaf, _ in texts(None)] == [12, 14, 15, 1]
    assert [leaf for _, leaf, _ in texts(2)] == [14, 15, 1]
    ring = spark.createDataFrame([(1, 1, 2, 0.0, "", ""), (1, 2, 1, 0.0, "", "")], nodes.schema)
    with pytest.raises(ValueError, match="ring"):
        chat.tree_paths(ring)


def test_chat_digests_of_the_probe(spark):
    row = queries.op8_chat_formatting(spark, SMALL).where("conv_id = -7").first()
    text = queries.PROBE
    said = "".join(f"{r}\n{text}\n" for r in ("user", "assistant"))
    assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chat_runs_no_python(spark):
    plan = queries.op8_chat_formatting(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


PROSE = "It is the case that the word of the day was with us in the house, and that was it. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>", ""),
        ("plain text only", "plain text only"),
        ("<article><h1>A &amp; B</h1><p>one<br>two <b>three\n\t four</p><p>a | b | c</article><footer>f</footer>", "A & B\n\none two three four\n\na | b | c"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by x</p></header><p>Text.</p><div class='ad'>Buy</div>"
         "<aside>More</aside><form><p>In</p></form><ul><li><a href=1>rel</a></li></ul></article><section id=comments><p>" + PROSE * 4, "T\n\nText."),
        ("<article class=comment><p>no</p></article><main><p>yes &lt;p&gt; &#233;&nbsp;x</p></main><p>no</p>", "yes <p> é x"),
        ("<script>var t='</p>';</script><style>p{}</style><article><p>in<!-- <p>not</p> --> one</p><p title='a>b'>q</p>", "in one\n\nq"),
        ("<div class=menu><a>Home</a></div><div><h2>Head</h2><p>" + PROSE * 4 + "<p>Short.<p>" + PROSE * 4 + "</div><p><a href=x>" + PROSE + "</a>",
         "\n\n".join(["Head", (PROSE * 4).strip(), "Short.", (PROSE * 4).strip()])),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><p class=\"x", "cut"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_an_article_is_not_all_there_is():
    long = (PROSE * 4).strip()
    # A teaser beside the main text; its blocks are no text.
    teaser = f"<div><p>{long}<p>{long}<p>Short.<p>{long}</div><article><h3>Next story</h3><p>Read on</article>"
    assert html.main_text(teaser) == "\n\n".join([long, long, "Short.", long])
    # A lead before the article, and text in main beside it.
    beside = f"<main><p>{PROSE}</p><article><h1>Title</h1><p>{long}</p><p>{long}</p></article><p>{PROSE}</p><p>Top</p></main>"
    assert html.main_text(beside) == "\n\n".join([PROSE.strip(), "Title", long, long, PROSE.strip()])


@pytest.mark.parametrize(
    "prose",
    [
        "Вчера вечером жители города собрались на площади, чтобы обсудить новый мост через реку. Решение примут весной.",
        "昨天晚上，城里的居民聚集在广场上，讨论河上的新桥应该建在什么地方。市长说，最后的决定将在明年春天作出，届时会公布全部费用。",
        "Wczoraj wieczorem mieszkańcy miasta zebrali się na rynku, aby omówić budowę nowego mostu. Decyzja zapadnie wiosną.",
    ],
)
def test_pages_in_other_languages_keep_their_text(prose):
    page = f"<nav><a>A</a></nav><div><p>{prose}</p><p>{prose * 3}</p></div><div><a href=1>{prose}</a></div><footer>{prose}</footer>"
    assert html.main_text(page) == f"{prose}\n\n{prose * 3}"


def test_pages_with_odd_rows(spark):
    schema = "page_id long, html string, main_text int, whole_page int"
    rows = [(1, None, 1, 1), (2, "", 1, 1), (3, "<article><p>" + "x " * 300_000 + "</p></article>", 1, 1), (3, "<article>y", 1, 1)]
    made, name = html.extract(spark.createDataFrame(rows, schema))
    got = sorted((r["page_id"], len(r[name])) for r in made.collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 599_999)]
    assert html.extract(spark.createDataFrame([], schema))[0].collect() == []


def test_each_operator_is_registered_once():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
