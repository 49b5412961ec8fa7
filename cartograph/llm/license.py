"""License scans by diagonal voting.

Every rolling hash of ``GRAM`` words of every document is joined to the places where the license
templates have it. Each hit votes for a diagonal (word of the document minus word of the template);
votes are summed by document, template and diagonal, neighbouring diagonals are merged to spans, so
that a word more or less does no harm, and the words of each span are compared with the template.
A template is found if ``AGREE`` of its words are there, in order, among them all that tell its license
from others (names and versions), no word of ``OTHERS`` comes between, and none agrees better with the
same place (licenses differ from each other by few words). A statement that several licenses share counts
only with the license's name near it. The templates are a fixed, short
list, so their side of the join is broadcast.

Beside that, fixed phrases are looked for word by word; their labels always stay.

Words are runs of letters, digits and characters beyond ASCII, after A-Z are lower-cased.

Cases: null texts are empty; rows that share an id are told apart by a hash of their text; repeated
rows are judged each; a template with fewer words than a gram is not allowed; an empty table gives
an empty table; names of further columns are free.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import ALNUM_FOLDED, Words, map_slices, plain, split_words
from cartograph.session import stage

GRAM = 3
AGREE = 0.8
#: Diagonals this far apart are one span.
NEIGHBOUR = 3
#: Words on either side of a shared statement in which the license is named.
NEAR = 60

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

class Template(NamedTuple):
    label: str
    text: str
    #: Of a statement that several licenses share: words of which one stands near it.
    near: tuple[str, ...] = ()


# Statements of public licenses and their labels.
STATEMENTS = [
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("apache",),
    ),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    Template("mit", "mit license copyright"),
    Template("ecl-2.0", "licensed under the educational community license version 2.0"),
    Template("cddl", "subject to the terms of the common development and distribution license"),
    Template("bsl-1.0", "boost software license version 1.0"),
    Template("bsd-2-clause", "bsd 2 clause license"),
    Template("bsd-3-clause", "bsd 3 clause license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    Template(
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted",
    ),
    Template("isc", "isc license copyright"),
    Template("isc", "licensed under the isc license"),
    Template(
        "hpnd",
        "permission to use copy modify and distribute this software and its documentation for any purpose "
        "and without fee is hereby granted",
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Kinds and versions of one family of licenses.
CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Names in identifier lines, and their labels where they differ.
SPDX = (
    "apache 2.0", "mit", "isc", "bsd 2 clause", "bsd 3 clause", "gpl 2.0", "gpl 3.0", "lgpl 2.1", "lgpl 3.0",
    "agpl 3.0", "mpl 2.0", "epl 2.0", "cddl 1.0", "ecl 2.0", "bsl 1.0", "hpnd", "unlicense", "zlib", "cc0 1.0",
)
SPDX_LABELS = {"lgpl 2.1": "lgpl", "lgpl 3.0": "lgpl", "cddl 1.0": "cddl"}


def _families() -> list[Template]:
    """Identifier lines, and the kinds of creative commons by name, with a version or (where the kind is
    more than a common pair of words) without."""
    lines = [Template(SPDX_LABELS.get(x, x.replace(" ", "-")), f"spdx license identifier {x}") for x in SPDX]
    kinds = [Template("cc " + k, "cc " + k) for k in CC_KINDS if " " in k]
    kinds += [Template(f"cc {k} {v}", f"cc {k} {v}") for k in CC_KINDS for v in CC_VERSIONS]
    return lines + [t._replace(label=t.label.replace(" ", "-")) for t in kinds]


TEMPLATES = STATEMENTS + _families()


# Words that do not tell a license, words that do in a long statement, and words that
# make another license of a statement they are put into. Numbers always tell.
COMMON = frozenset("licensed released under the a license version v".split())
NAMES = frozenset("apache mit bsd isc gnu lesser affero mozilla".split())
OTHERS = frozenset("lesser affero sa nc nd".split())
#: In a template of fewer words all but the common ones tell the license.
STATEMENT = 12


def telling(template: list[str]) -> set[str]:
    """The words of the template that have to be there."""
    if len(template) < STATEMENT:
        return set(template) - COMMON
    return {w for w in template if w in NAMES or w.isdigit()}


def template_words() -> list[list[str]]:
    texts = split_words(pa.array([t.text for t in TEMPLATES]), ALNUM_FOLDED)
    words = [texts.distinct[int(c)].as_py() for c in texts.codes]
    return [words[a:b] for a, b in zip(texts.starts, texts.starts[1:], strict=False)]


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(hashes: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Rolling hash of every ``width`` words, from the words' own hashes."""
    out = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width if len(out) else 0):
        out = out * _MULTIPLY + hashes[k : k + len(out)]
    return out.view(np.int64)


def template_grams() -> list[np.ndarray]:
    """The rolling hashes of each template."""
    return [
        gram_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)) for words in template_words()
    ]


def template_table(spark) -> DataFrame:
    """(h, template, place, size): where each gram stands in the templates."""
    rows = [
        (int(h), i, at, len(own) + GRAM - 1) for i, own in enumerate(template_grams()) for at, h in enumerate(own)
    ]
    return spark.createDataFrame(rows, "h long, template int, place int, size int")


def places_of_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes and the words where they start, within one document each."""
    h, owner = gram_hashes(words.hashes()), words.owner
    inside = np.flatnonzero(owner[: len(h)] == owner[GRAM - 1 :]) if len(h) else np.zeros(0, int)
    return h[inside], inside


def grams(docs: DataFrame) -> DataFrame:
    """(id, told, h, at): every rolling hash of every document."""
    schema = T.StructType(
        [*docs.schema.fields[:2], T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType())]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch["text"]), ALNUM_FOLDED)
        h, inside = places_of_grams(words)
        owner = words.owner[inside]
        own = pa.array(owner)
        return {
            "id": batch["id"].take(own),
            "told": batch["told"].take(own),
            "h": h,
            "at": inside - words.starts[owner],
        }

    return map_slices(docs, "text", work, schema)


def vote(docs: DataFrame) -> DataFrame:
    """(id, told, spans): per document the spans (template, first, last) that got votes enough."""
    hits = grams(docs).join(F.broadcast(template_table(docs.sparkSession)), "h")
    votes = hits.groupBy("id", "told", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.first("size").alias("size"),
    )
    near = Window.partitionBy("id", "told", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near) > NEIGHBOUR
    spans = votes.withColumn("start", F.coalesce(apart.cast("int"), F.lit(0)))
    spans = spans.withColumn("span", F.sum("start").over(near)).groupBy("id", "told", "template", "span").agg(
        F.sum("votes").alias("votes"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.first("size").alias("size"),
    )
    # A word that differs costs ``GRAM`` votes, so the bound leaves room for the words allowed to.
    least = F.greatest(F.lit(1), F.col("size") - GRAM + 1 - GRAM * F.ceil((1 - AGREE) * F.col("size")))
    return spans.where(F.col("votes") >= least).groupBy("id", "told").agg(
        F.collect_list(F.struct("template", "first", "last")).alias("spans")
    )


def agreement(words: list[str], template: list[str]) -> float:
    """Share of the template's words found in ``words``, in order; 0 if the license is another one."""
    blocks = SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()[:-1]
    there = {w for b in blocks for w in template[b.b : b.b + b.size]}
    between = set(words[blocks[0].a : blocks[-1].a + blocks[-1].size]) if blocks else set()
    if not telling(template) <= there or between & OTHERS - set(template):
        return 0.0
    return sum(b.size for b in blocks) / len(template)


def best_of_place(shares: list[tuple[float, int, str, dict]]) -> list[tuple[str, float]]:
    """(label, share) of the spans that no better one overlaps: more agreement, then more words."""
    taken: set[int] = set()
    best = []
    for share, _, label, span in sorted(shares, key=lambda x: (-x[0], -x[1], x[2], x[3]["first"])):
        place = range(span["first"], span["last"] + GRAM)
        if taken.isdisjoint(place):
            taken.update(place)
            best.append((label, share))
    return best


def phrase_places(words: Words, phrase: list[str]) -> np.ndarray:
    """Words where the phrase starts, within one document."""
    found = pc.index_in(pa.array(phrase), value_set=words.distinct)
    last = len(words.codes) - len(phrase) + 1
    if found.null_count or last < 1:
        return np.zeros(0, np.int64)
    owner = words.owner
    here = owner[:last] == owner[len(phrase) - 1 :]
    for k, code in enumerate(np.asarray(found)):
        here &= words.codes[k : k + last] == code
    return np.flatnonzero(here)


RESULT = [
    ("n_words", T.LongType()),
    ("n_base", T.LongType()),
    ("first_word", T.LongType()),
    ("last_word", T.LongType()),
    ("base_labels", T.StringType()),
    ("labels", T.StringType()),
    ("score", T.DoubleType()),
]


def digests(docs: DataFrame) -> DataFrame:
    """(id, told, n_words, n_base, first_word, last_word, base_labels, start, excerpt) of every document.

    The excerpt is all that a template can be compared with: the words, from ``start`` on, between the
    first and the last gram that any template has, and ``NEAR`` more on either side. Most documents
    have none, so their texts need not meet the spans.
    """
    known = np.unique(np.concatenate(template_grams()))
    text, whole = T.StringType(), T.LongType()
    schema = T.StructType(
        [
            *docs.schema.fields[:2],
            *(T.StructField(n, t) for n, t in RESULT[:5]),
            T.StructField("start", whole),
            T.StructField("excerpt", text),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch["text"]), ALNUM_FOLDED)
        n = batch.num_rows
        counts, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in PHRASES.items():
            places = phrase_places(words, phrase.split())
            owner = words.owner[places]
            np.add.at(counts, owner, 1)
            for d, at in zip(owner.tolist(), (places - words.starts[owner]).tolist(), strict=True):
                base[d].add(label)
                first[d] = at if first[d] is None else min(first[d], at)
                last[d] = at if last[d] is None else max(last[d], at)
        h, inside = places_of_grams(words)
        hits = inside[np.isin(h, known)]
        start, excerpt = [0] * n, [None] * n
        own, begins = np.unique(words.owner[hits], return_index=True)
        ends = np.append(begins[1:], len(hits))[: len(own)]
        for d, low, high in zip(own.tolist(), hits[begins], hits[ends - 1], strict=True):
            a = max(int(words.starts[d]), int(low) - NEAR)
            b = min(int(words.starts[d + 1]), int(high) + GRAM + NEAR)
            start[d] = a - int(words.starts[d])
            # No word has a space.
            excerpt[d] = " ".join(words.distinct.take(pa.array(words.codes[a:b])).to_pylist())
        return {
            "id": batch["id"],
            "told": batch["told"],
            "n_words": words.counts,
            "n_base": counts,
            "first_word": first,
            "last_word": last,
            "base_labels": [",".join(sorted(x)) for x in base],
            "start": start,
            "excerpt": excerpt,
        }

    return map_slices(docs, "text", work, schema)


def compare(words: list[str], span: dict, template: Template, own: list[str]) -> float:
    """Agreement of a span of ``words`` with a template and its words ``own``; 0 if it is not named near."""

    def around(margin: int) -> list[str]:
        return words[max(0, span["first"] - margin) : span["last"] + GRAM + margin]

    if template.near and not set(template.near) & set(around(NEAR)):
        return 0.0
    return agreement(around(NEIGHBOUR), own)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, :data:`RESULT`) of every document; the score is the best template's share of words."""
    told = F.xxhash64(docs[text])
    marked = docs.select(docs[doc_id].alias("id"), told.alias("told"), docs[text].alias("text"))
    # Few documents have one: staged, their true size is known, so that the digests mostly stay in place.
    spans = stage(vote(marked), "license-spans").df.select(F.col("id").alias("i"), F.col("told").alias("t"), "spans")
    found = digests(marked)
    joined = found.join(spans, found["id"].eqNullSafe(spans["i"]) & (found["told"] == spans["t"]), "left").drop("i", "t")
    templates = template_words()
    schema = T.StructType(
        [T.StructField("doc_id", marked.schema["id"].dataType), *(T.StructField(n, t) for n, t in RESULT)]
    )

    def work(batch: pa.RecordBatch) -> dict:
        base = batch["base_labels"].to_pylist()
        labels, scores = [set(b.split(",")) - {""} for b in base], [1.0 if b else 0.0 for b in base]
        for d, spans in enumerate(batch["spans"].to_pylist()):
            if not spans:
                continue
            words, start = batch["excerpt"][d].as_py().split(" "), batch["start"][d].as_py()
            shares = []
            for span in spans:
                template, own = TEMPLATES[span["template"]], templates[span["template"]]
                here = span | {"first": span["first"] - start, "last": span["last"] - start}
                share = compare(words, here, template, own)
                if share >= AGREE:
                    shares.append((share, len(own), template.label, span))
            for label, share in best_of_place(shares):
                labels[d].add(label)
                scores[d] = max(scores[d], share)
        return {
            "doc_id": batch["id"],
            **{c: batch[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")},
            "labels": [",".join(sorted(x)) for x in labels],
            "score": scores,
        }

    return map_slices(joined, "excerpt", work, schema)
