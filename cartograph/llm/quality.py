"""Quality rules by host.

Each document is judged by a few counts over its whole text. The failures are summed by host (the
``source`` column), each host's rate is shrunk towards the corpus by a beta prior fitted to all
hosts, and the verdict of the host is joined back to its documents.

Cases: a null text has no words and so fails; a null host is a host of its own; repeated rows are
judged and counted each; an empty table gives an empty table. The names of further columns are
free: nothing is added beside one struct, under a name the table does not have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import SPACED, free_name, map_slices, plain, split_words, sums
from cartograph.session import stage

#: A document fails the base rules with fewer words, or with a larger share of repeated words.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: And the further rules with more symbols or upper-case words for a hundred words.
MOST_SYMBOLS_PERCENT = 10
MOST_UPPER_PERCENT = 30
#: A host is rejected when its shrunk rate of failing documents is above this share.
HOST_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words")


def repeated_words(codes: np.ndarray, starts: np.ndarray, width: int = 3) -> np.ndarray:
    """Per document, its words inside windows of ``width`` words found twice or more in it."""
    n = len(codes)
    if n < width:
        return np.zeros(len(starts) - 1, np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    last = n - width + 1
    inside = owner[:last] == owner[width - 1 :]
    # Exact ids: a window's id is that of its first words paired with the next word.
    ids = owner[:last]
    for k in range(width):
        word = codes[k : k + last]
        ids = pd.factorize(ids * (int(word.max()) + 1) + word)[0]
    often = inside & (np.bincount(ids[inside], minlength=int(ids.max()) + 1)[ids] > 1)
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : k + last] |= often
    return sums(covered.astype(np.int64), starts)


def duplicate_lines(text: pa.Array) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line of it."""
    lines = pc.split_pattern(text, "\n")
    flat = lines.flatten()
    starts = np.asarray(lines.offsets)
    starts = starts - starts[0]
    owner = np.repeat(np.arange(len(text)), np.diff(starts))
    coded = flat.dictionary_encode()
    key = owner * (len(coded.dictionary) + 1) + np.asarray(coded.indices)
    wordy = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]"))
    again = pd.Series(key).duplicated().to_numpy()
    if len(wordy):
        again &= wordy[np.asarray(coded.indices)]
    return sums(again.astype(np.int64), starts)


def count_batch(text: pa.Array) -> dict[str, np.ndarray]:
    words = split_words(text, SPACED)
    chars = np.asarray(pc.utf8_length(words.distinct)).astype(np.int64)
    upper = np.asarray(pc.utf8_is_upper(words.distinct)) & (chars > 1)
    return {
        "n_words": words.counts,
        "word_chars": sums(chars[words.codes], words.starts),
        "n_symbols": np.asarray(pc.count_substring_regex(text, r"[#*$%&|<>]")).astype(np.int64),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words.codes, words.starts),
        "n_upper_words": sums(upper[words.codes].astype(np.int64), words.starts),
    }


def rule_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all, if none are named) and a struct of :data:`COUNTS`; its name."""
    keep = docs.columns if keep is None else keep
    name = free_name(docs.columns, "rules")
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    # The text comes along under a name of its own, as ``keep`` may leave it out.
    whole = free_name([*docs.columns, name], "whole_text")
    source = docs.select(*(docs[c] for c in keep), docs[text].alias(whole))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, counts)])

    def work(batch: pa.RecordBatch) -> dict:
        made = count_batch(plain(batch[whole]))
        struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made.values()], list(made))
        return {**{c: batch[c] for c in keep}, name: struct}

    return map_slices(source, whole, work, schema), name


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (
        100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"]
    )


def rule_failed(c: Column) -> Column:
    return (
        base_failed(c)
        | (100 * c["n_symbols"] > MOST_SYMBOLS_PERCENT * c["n_words"])
        | (100 * c["n_upper_words"] > MOST_UPPER_PERCENT * c["n_words"])
    )


def host_verdicts(counted: DataFrame, rules: str, host: str) -> DataFrame:
    """(host, bad_host): one row per host, after shrinking its rate of failing documents.

    The prior is a beta distribution with the corpus rate as its mean. Its weight comes from the
    spread of the hosts' rates beyond what chance gives for their sizes (method of moments).
    """
    hosts = stage(
        counted.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(rule_failed(F.col(rules)).cast("long")).alias("bad"),
        ),
        "hosts",
        # Five sums over all hosts, taken while they are written.
        docs=F.sum("n"),
        bad=F.sum("bad"),
        bad_sq=F.sum(F.col("bad") * F.col("bad") / F.col("n")),
        n_sq=F.sum(F.col("n") * F.col("n").cast("double")),
    )
    mean, weight = beta_prior(hosts.rows, hosts.metrics)
    shrunk = (F.col("bad") + mean * weight) / (F.col("n") + weight)
    return hosts.df.select("host", (100 * shrunk > HOST_PERCENT).alias("bad_host"))


def beta_prior(hosts: int, m: dict) -> tuple[float, float]:
    """(mean, weight in documents) from the sums over hosts."""
    n = m["docs"] or 0
    if not n:
        return 0.0, 1.0
    mean = m["bad"] / n
    between = m["bad_sq"] - n * mean * mean - (hosts - 1) * mean * (1 - mean)
    spread = between / max(n - m["n_sq"] / n, 1e-9) if hosts > 1 else 0.0
    if mean * (1 - mean) <= 0:
        return mean, 1.0
    rho = min(max(spread / (mean * (1 - mean)), 1e-3), 0.5)
    return mean, 1 / rho - 1


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct of the counts, ``base_failed``, ``bad_host`` and ``kept``.

    Kept are documents that pass all rules and whose host passes. The counts are staged once, since
    both the hosts' sums and the join of their verdicts need them.
    """
    keep = docs.columns if keep is None else keep
    counted, rules = rule_counts(docs, text, list(dict.fromkeys([*keep, host])))
    counted = stage(counted, "rule-counts").df
    verdicts = host_verdicts(counted, rules, host)
    taken = counted.columns
    key, bad = free_name(taken, "host"), free_name(taken, "bad_host")
    verdicts = verdicts.select(F.col("host").alias(key), F.col("bad_host").alias(bad))
    c = F.col(rules)
    judged = counted.join(verdicts, F.col(host).eqNullSafe(F.col(key)), "left").select(
        *(counted[x] for x in keep),
        F.struct(
            *(c[x].alias(x) for x in COUNTS),
            base_failed(c).alias("base_failed"),
            F.col(bad).alias("bad_host"),
            (~rule_failed(c) & ~F.col(bad)).alias("kept"),
        ).alias(rules),
    )
    return judged, rules


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    judged, rules = quality_rules(docs, text, host)
    return judged.where(F.col(rules)["kept"]).select(*docs.columns)
