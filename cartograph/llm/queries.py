"""Queries of this subpackage over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import alignment, brown, chat, decontaminate, html, langid, license, mixing, packing, quality, simhash, substring, trie

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_SQL = r"""
WITH words AS (
    SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
),
often AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
),
repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
        SELECT doc_id, line, count(*) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
    GROUP BY doc_id
),
counts AS (
    SELECT doc_id, source, coalesce(len(w), 0) AS n_words,
        coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
        coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(len([x for x in w if length(x) > 1 AND upper(x) = x AND lower(x) <> x]), 0) AS n_upper
    FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
),
failed AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_upper > 30 * n_words AS rule_failed
    FROM counts
),
hosts AS (
    SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE rule_failed)::DOUBLE AS bad
    FROM failed GROUP BY source
),
moments AS (
    SELECT sum(n) AS docs, sum(bad) / sum(n) AS mean, count(*) AS hosts,
        sum(bad * bad / n) AS bad_sq, sum(n * n) AS n_sq FROM hosts
),
prior AS (
    SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1 ELSE
        1 / least(greatest(CASE WHEN hosts > 1 THEN
            (bad_sq - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / greatest(docs - n_sq / docs, 1e-9)
            ELSE 0 END / (mean * (1 - mean)), 1e-3), 0.5) - 1 END AS weight
    FROM moments
),
verdicts AS (
    SELECT source, 100 * (bad + mean * weight) / (n + weight) > 50 AS bad_host FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT rule_failed AND NOT bad_host AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, its base verdict, and the verdict with its host's."""
    docs = table(spark, sf_dir, "documents")
    judged, rules = quality.quality_rules(docs, keep=["doc_id"])
    c = F.col(rules)
    return judged.select(
        "doc_id",
        *(c[x].alias(x) for x in quality.COUNTS if x != "n_upper_words"),
        c["base_failed"].alias("base_failed"),
        c["kept"].alias("kept"),
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SUBSTRING_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
),
later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows)
    WHERE k > 1
),
gone AS (
    SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)
),
each AS (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
),
kept AS (
    SELECT each.doc_id, string_agg(w[each.i], ' ' ORDER BY each.i) AS t, count(*) AS n
    FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id
)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", SUBSTRING_SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those that go, and a digest of what stays."""
    made, name = substring.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"])
    r = F.col(name)
    return made.select("doc_id", *(r[k].alias(k) for k in ("n_words", "n_removed", "kept_sha256")))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with each item that contaminates it."""
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, tests)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part of every document goes."""
    return packing.pack(table(spark, sf_dir, "documents"), near=True)


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    made, name = html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


# The two texts of conversation -7, as the contract of this query has them.
PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text END AS loss,
        length(role) + length(text) + length(regexp_replace(role || chr(0) || text, '[^\\]', '', 'g'))
        + len(regexp_extract_all(role || chr(0) || text,
            '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>'))
        + 33 AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(loss)), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(loss, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op8_chat_formatting", CHAT_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the format."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    nodes = chat.turn_chain(given.unionByName(probe))
    back = chat.read_back(chat.format_trees(nodes, branches=1))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return license.scan(table(spark, sf_dir, "documents"))


def _fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    # A null id has no fold; its row is predicted only.
    held_out = F.coalesce(_fold(3) == 1, F.lit(True))
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based score of every document, learned from six of seven folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(7) == 2, F.lit(True))
    return brown.score(docs, ~held_out)


TRIE_SQL = r"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten([
            [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(conv_id::VARCHAR, '')])),
        lambda crc, x: xor(xor(crc, x) >> 1, CASE WHEN xor(crc, x) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)),
        4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM own)
),
rebuilt AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM (
        SELECT ids.conv_id, 0 AS part, pos, role, text FROM ids JOIN own ON own.conv_id = base AND pos <= h
        UNION ALL
        SELECT ids.conv_id, 1, pos, role, text FROM ids JOIN own ON own.conv_id = ids.conv_id AND pos > h)
),
prefixes AS (
    SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids
),
nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM prefixes GROUP BY node, d
),
ends AS (
    SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM prefixes JOIN (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id) USING (conv_id, d) GROUP BY node
),
above AS (
    SELECT nodes.node, up.node AS parent, up_node.conv_id AS parent_conv_id
    FROM nodes JOIN prefixes up ON up.conv_id = nodes.conv_id AND up.d = nodes.d - 1
    JOIN nodes up_node ON up_node.node = up.node
),
children AS (SELECT parent AS node, count(*) AS n_children FROM above GROUP BY parent),
below AS (
    SELECT up.node, sum((nodes.n - 1) * nodes.words) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
    FROM nodes LEFT JOIN children USING (node) JOIN prefixes up ON up.conv_id = nodes.conv_id AND up.d <= nodes.d
    GROUP BY up.node
)
SELECT nodes.conv_id, d::BIGINT AS depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children,
    leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN above USING (node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node)
"""


@query("op11_conversation_trie", TRIE_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    own = trie.paths(table(spark, sf_dir, "conversations"))
    return trie.trie_nodes(trie.borrow_heads(own))


@query("op12_source_mixing")
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the target of its source."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers."""
    return alignment.align_documents(table(spark, sf_dir, "documents"))[0]
