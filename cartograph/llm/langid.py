"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: the runs of 1 to ``LONGEST`` bytes of its
lower-cased letters, words set apart by one space, each hashed to one of ``BUCKETS`` rows. A linear
layer and a softmax over the languages follow. Both are trained by stochastic gradient descent in
numpy. Mean and layer are linear, so for prediction the table of embeddings is multiplied with the
layer once, and a text of any length is one pass over a table of a few numbers a row.

The labelled rows are bounded: at most ``SAMPLE`` of each language, those with the smallest hash of
their id and text. Each teaches with its whole text, counted by the tasks: the driver gets how often
each bucket occurs, at most ``BUCKETS`` numbers a row however long the text is. A part of the rows
is held back to calibrate: a temperature is fitted to it, and ``reject`` is the score below
which a prediction is less sure than ``PRECISION`` asks for.

Cases: a null text and one without letters are ``und``, with score 0; rows without a language are
predicted, not learned from; repeated rows are predicted each; without any labelled row all
predictions are ``und``; an empty table gives an empty table; names of further columns are free.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import map_slices, plain, raw
from cartograph.session import stage

BUCKETS = 1 << 15
LONGEST = 3
DIMENSIONS = 16
SAMPLE = 400
#: Rows a language that are ranked for its sample, as a multiple of it.
SPARE = 4
EPOCHS = 6
RATE = 0.5
#: Part of the sample that calibrates, and the precision that accepted predictions should have.
HELD_BACK = 5
PRECISION = 0.98
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float


def letters_only(text: pa.Array) -> pa.Array:
    """Lower-case letters; everything between them is one space, also at both ends."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(text), r"[^\pL\pM]+", " ")
    return pc.binary_join_element_wise(" ", pc.utf8_trim(spaced, " "), " ", "")


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the run of 1, 2, ... bytes that ends at each byte."""
    out, h = [], np.zeros(len(data), np.uint32)
    for k in range(LONGEST):
        # h(i) covers bytes i - k to i: the hash of the shorter run before it, and the byte itself.
        h = (np.concatenate([np.zeros(1, np.uint32), h[:-1]]) * np.uint32(0x01000193) + data) * np.uint32(0x85EBCA6B)
        out.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


class Bag(NamedTuple):
    """How often each bucket occurs in a text of ``size`` bytes of letters."""

    buckets: np.ndarray
    times: np.ndarray
    size: int


def _features(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    data, offsets = raw(letters_only(text))
    return subwords(data), offsets.astype(np.int64)


def bags(text: pa.Array) -> list[Bag]:
    buckets, offsets = _features(text)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        times = sum(np.bincount(b[lo + k : hi], minlength=BUCKETS) for k, b in enumerate(buckets))
        used = np.flatnonzero(times)
        out.append(Bag(used, times[used], int(hi - lo)))
    return out


def logits(text: pa.Array, model: Model) -> np.ndarray:
    """Per text and language; the mean over a text's subwords. Runs across two texts don't count."""
    buckets, offsets = _features(text)
    total = np.zeros((len(text), len(model.languages)))
    inside = np.arange(len(buckets[0])) - np.repeat(offsets[:-1], np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    for c in range(len(model.languages)):
        own = np.ascontiguousarray(model.table[:, c])
        score = np.zeros(len(inside) + 1)
        for k, b in enumerate(buckets):
            np.add(score[1:], own[b] * (inside >= k), out=score[1:])
        score = np.cumsum(score)
        total[:, c] = (score[offsets[1:]] - score[offsets[:-1]]) / (size * LONGEST) + model.bias[c]
    return total


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(known: list[Bag], labels: list[str], seed: int = 7) -> Model:
    """Embeddings and layer by SGD on single texts; temperature and rejection on the rest."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(known))
    learn = order[len(order) // HELD_BACK :] if len(order) >= 2 * HELD_BACK else order
    check = order[: len(order) // HELD_BACK] if len(order) >= 2 * HELD_BACK else order
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate, (used, times, _) = RATE * (1 - done / steps), known[i]
            done += 1
            if not len(used):
                continue
            share = times / times.sum()
            mean = share @ embed[used]
            wrong = softmax((mean @ layer + bias)[None])[0]
            wrong[target[i]] -= 1
            back = layer @ wrong
            layer -= rate * np.outer(mean, wrong)
            bias -= rate * 0.1 * wrong
            # The gradient of a subword is its share of the mean; repeated ones add up.
            embed[used] -= rate * (share * min(len(used), 200))[:, None] * back
    model = Model(languages, (embed @ layer).astype(np.float32), bias, 1.0, 0.0)
    score = [known[i].times @ model.table[known[i].buckets] / max(known[i].size * LONGEST, 1) + bias for i in check]
    return _calibrated(model, np.array(score), target[check])


def _calibrated(model: Model, known: np.ndarray, target: np.ndarray) -> Model:
    """The temperature with the least log loss, then the smallest score that is precise enough.

    As in Platt's calibration the aim is not 1 but (n + 1) / (n + 2): without an error among n rows
    one must still be expected.
    """
    rows, aim = np.arange(len(target)), (len(target) + 1) / (len(target) + 2)

    def loss(t: float) -> float:
        p = np.clip(softmax(known / t)[rows, target], 1e-12, 1 - 1e-12)
        return float(-(aim * np.log(p) + (1 - aim) * np.log(1 - p)).mean())

    temperature = min(np.geomspace(0.05, 50, 81), key=loss)
    chance = softmax(known / temperature)
    order = np.argsort(-chance.max(axis=1), kind="stable")
    right = np.cumsum((chance.argmax(axis=1) == target)[order]) / (1 + rows)
    good = np.flatnonzero(right >= PRECISION)
    reject = float(chance.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model._replace(temperature=float(temperature), reject=reject)


def labelled_sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> tuple[list[Bag], list[str]]:
    """The bags of at most ``SAMPLE`` different rows of each language.

    They are those with the smallest hash of id and text. A third of all rows may have one language:
    from the number of its hashes follows below which value some ``SPARE`` times the sample lie, and
    only these are ranked, so a language costs its task the same however many rows and partitions
    it has.
    """
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(
        docs[lang].alias("lang"),
        F.xxhash64(docs[doc_id], docs[text]).alias("h"),
        docs[text].alias("text"),
    )
    slim = stage(rows.select("lang", "h"), "hashes").df
    sizes = stage(slim.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages").df
    place = F.col("h").cast("double") / float(1 << 64) + 0.5
    low = slim.join(sizes, "lang").where(place * F.col("n") <= SPARE * SAMPLE).select("lang", "h").distinct()
    best = Window.partitionBy("lang").orderBy("h")
    ranked = low.withColumn("k", F.row_number().over(best)).where(F.col("k") <= SAMPLE)
    # A few rows for each language: staged, their size is known, so the texts are not shuffled.
    chosen = stage(ranked.select("lang", "h"), "sample").df
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            *slim.schema.fields,
            T.StructField("buckets", numbers),
            T.StructField("times", T.ArrayType(T.LongType())),
            T.StructField("size", T.LongType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        buckets, times, size = zip(*bags(plain(batch["text"])), strict=True)
        return {"lang": batch["lang"], "h": batch["h"], "buckets": buckets, "times": times, "size": size}

    counted = map_slices(rows.join(chosen, ["lang", "h"]).select("lang", "h", "text"), "text", work, schema)
    one = counted.groupBy("lang", "h").agg(F.min(F.struct("buckets", "times", "size")).alias("bag"))
    taken = one.orderBy("lang", "h").collect()
    known = [Bag(np.array(r["bag"]["buckets"], np.int64), np.array(r["bag"]["times"]), r["bag"]["size"]) for r in taken]
    return known, [r["lang"] for r in taken]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (free of the new names), ``lang_pred``, ``score`` and ``accepted``."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*(docs[c] for c in keep), docs[text].alias("whole_text"))
    schema = T.StructType(
        [
            *source.schema.fields[:-1],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        model, texts = shared.value, plain(batch["whole_text"])
        wordy = np.asarray(pc.match_substring_regex(texts, r"\pL"))
        if not model.languages:
            wordy[:] = False
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        else:
            chance = softmax(logits(texts, model) / model.temperature)
            best, score = chance.argmax(axis=1), chance.max(axis=1)
        names = [*model.languages, UNKNOWN]
        return {
            **{c: batch[c] for c in keep},
            "lang_pred": [names[i] if w else UNKNOWN for i, w in zip(best, wordy, strict=True)],
            "score": np.where(wordy, score, 0.0),
            "accepted": wordy & (score >= model.reject),
        }

    return map_slices(source, "whole_text", work, schema)


def identify(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row; rows where ``learn`` is true may teach."""
    model = train(*labelled_sample(docs.where(learn), text, lang, doc_id))
    return predict(docs.select(docs[doc_id], docs[text]), model, text, [doc_id])
