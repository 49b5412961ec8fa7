"""Sources to a token table with lines, bracket depths and neighbours.

The texts are shuffled once, by path, before they are exploded. Every window below is keyed by the
path (and more), so none of them moves tokens again. A group is never larger than one file, which
is one cell of the source table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from cartograph.functions.lexis import (
    interpolation,
    is_blank,
    is_comment,
    is_name,
    is_trivia,
    lex,
    newlines,
    opens_string,
)
from cartograph.functions.text import LANGUAGES, language_of
from cartograph.session import new_path

ALL_LANGUAGES = tuple(dict.fromkeys(LANGUAGES.values()))

# Tokens kept behind a possible declaration at most, so that its parameter list can be cut out
# without the file. Longer ones are cut from the file itself (see ``extract._with_parameters``).
AHEAD = 64


def in_order() -> WindowSpec:
    return Window.partitionBy("path").orderBy("pos")


def before_row() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


# Bytes of text to a partition of the token table, which takes some hundred times as much in the
# sorts of a task; they shall fit in a core's share of the memory.
PART_BYTES = 2 << 20


def by_language(
    sources: DataFrame, languages: tuple[str, ...]
) -> tuple[DataFrame, dict[str, int], tuple[str, ...]]:
    """The supported files, staged once in one folder per language; the partitions to lex each
    language in; and the languages that have files (the first one asked for, if none has).

    Each language is then read and lexed by a plan of its own: small generated code, and no file
    is read for a language it is not written in.
    """
    path = new_path(sources.sparkSession, "texts")
    lang, seen = language_of(F.col("path")), Observation()
    (
        sources.select("path", "content", lang.alias("lang"))
        .where(F.col("lang").isin(*languages))
        .observe(
            seen,
            *(F.count(F.when(F.col("lang") == name, 1)).alias(name) for name in languages),
            *(
                F.sum(F.when(F.col("lang") == name, F.octet_length("content").cast("long"))).alias(f"{name}_bytes")
                for name in languages
            ),
        )
        .write.partitionBy("lang")
        .parquet(path)
    )
    schema = "path string, content string, lang string"
    spark = sources.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = seen.get
    parts = {name: max(least, -(-(found[f"{name}_bytes"] or 0) // PART_BYTES)) for name in languages}
    present = tuple(name for name in languages if found[name]) or languages[:1]
    return spark.read.schema(schema).parquet(path), parts, present


def dealt(sources: DataFrame, lang: str, parts: int) -> DataFrame:
    """(path, content): the files of the language, hash partitioned by path.

    Tokens take far more room than text, so the partitions are set by the bytes of text, not left
    to be merged by the size of this shuffle.
    """
    own = F.col("lang") if "lang" in sources.columns else language_of(F.col("path"))
    return sources.where(own == lang).select("path", "content").repartition(parts, "path")


def prepare(sources: DataFrame, lang: str, parts: int) -> DataFrame:
    """(path, toks): one row per file of the language, hash partitioned by path."""
    return dealt(sources, lang, parts).select("path", lex(F.col("content"), lang).alias("toks"))


def tokens(sources: DataFrame, lang: str) -> DataFrame:
    """(path, pos, tok): every token of the files of one language, trivia included."""
    staged, parts, _ = by_language(sources, (lang,))
    return _exploded(staged, lang, parts[lang]).drop("toks")


def _exploded(sources: DataFrame, lang: str, parts: int) -> DataFrame:
    """(path, toks, pos, tok).

    The outer form keeps the optimizer from inferring ``size(lex(content)) > 0``, a filter it would
    push below the shuffle, where the text would be split once more.
    """
    return (
        prepare(sources, lang, parts)
        .select("path", "toks", F.posexplode_outer("toks").alias("pos", "tok"))
        .where(F.col("tok").isNotNull())
    )


def token_stats(sources: DataFrame, languages: tuple[str, ...] = ALL_LANGUAGES) -> DataFrame:
    """(path, lang, significant_tokens, strings, comments, chars, lines) of every file with a token.

    ``strings`` counts literals, an interpolated one once however many expressions it holds; ``chars``
    and ``lines`` are those of the whole file, which its tokens cover. The tokens are counted where
    they were lexed: the texts are shuffled by path, the counts are not shuffled again.
    """
    staged, parts, present = by_language(sources, languages)
    return reduce(DataFrame.unionByName, (_stats(staged, lang, parts[lang]) for lang in present))


def _stats(staged: DataFrame, lang: str, parts: int) -> DataFrame:
    tok = F.col("tok")

    def number(test: Column) -> Column:
        return F.count(F.when(test, 1))

    return (
        _exploded(staged, lang, parts)
        .groupBy("path")
        .agg(
            F.lit(lang).alias("lang"),
            number(~is_trivia(tok, lang)).alias("significant_tokens"),
            number(opens_string(tok, lang)).alias("strings"),
            number(is_comment(tok, lang)).alias("comments"),
            F.sum(F.length(tok).cast("long")).alias("chars"),
            (F.sum(newlines(tok).cast("long")) + 1).alias("lines"),
        )
    )


def _at(offset: int) -> Column:
    return F.get(F.col("toks"), F.col("pos") + offset)


# The words a parameter list may follow, per language.
_DECLARING = {"python": ("def", "async"), "rust": ("fn",), "go": ("func",), "typescript": ("function",)}


def _may_declare(lang: str, tok: Column) -> Column:
    """Tokens a parameter list may follow; only decides which rows carry their ``ahead`` tokens."""
    keyword = tok.isin(*_DECLARING[lang])
    if lang == "typescript":
        opens = _at(1).isin("(", "<") | (_at(2) == "(")
        return keyword | ((_at(-1) != ".") & opens & is_name(tok))
    if lang == "go":
        # Behind a receiver it is the name that carries them.
        named = keyword & ~F.coalesce((_at(1) == "(") | (_at(2) == "("), F.lit(False))
        return named | ((_at(1) == "(") & ((_at(-1) == ")") | (_at(-2) == ")")) & is_name(tok))
    return keyword


def _ahead(lang: str, tok: Column) -> Column:
    """The tokens from a possible declaration on: ``AHEAD`` of them, or up to the first closing
    parenthesis, where one list without angle brackets ends. Every sort carries them along.
    """
    toks = F.slice("toks", F.col("pos") + 1, AHEAD)
    close = F.array_position(toks, ")").cast("int")
    first = F.slice(toks, 1, close)
    single = (F.size(F.array_remove(first, "(")) == close - 1) & ~F.array_contains(first, "<")
    return F.when(_may_declare(lang, tok), F.when((close > 0) & single, first).otherwise(toks))


def _generic_calls(rows: DataFrame) -> DataFrame:
    """Adds ``generic``: a name before type arguments that a parenthesis follows, as in ``f<A<B>>(``.

    The angle bracket behind the name is closed by the nearest ``>`` of its level, if no token that
    can't stand in type arguments comes between; comparisons have one. No length or depth is set.
    """
    tok = F.col("tok")
    barrier = tok.isin("(", ")", ";") | tok.contains("=")
    levelled = rows.select(
        "*",
        F.sum(barrier.cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)).alias("part"),
        (F.col("angle") - (tok == ">").cast("int")).alias("level"),
    )
    behind = (
        Window.partitionBy("path", "part", "level")
        .orderBy(F.desc("pos"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    closed = F.last(F.when(tok == ">", F.col("n1")), ignorenulls=True).over(behind)
    opened = F.when((tok == "<") & (F.col("n1") != ">"), F.coalesce(closed == "(", F.lit(False)))
    found = levelled.select(*rows.columns, opened.alias("types"))
    return found.select(
        *rows.columns,
        (F.col("named") & F.coalesce(F.lead("types").over(in_order()), F.lit(False))).alias("generic"),
    )


# The words of Rust that a rule looks for.
RUST_WORDS = ("fn", "struct", "let", "for", "in", "=")


def _telling(sources: DataFrame, parts: int) -> DataFrame:
    """The columns of :func:`significant` that Rust needs, for the tokens that a rule reads.

    The neighbours come from the array of the file's tokens, so that only brackets, words, called
    names, and tokens that move a line, a depth or an angle are sorted.
    """
    places = F.sequence(F.lit(0), F.size("toks") - 1)
    files = prepare(sources, "rust", parts).select(
        "path", "toks", F.filter(places, lambda n: ~is_trivia(F.get("toks", n), "rust")).alias("own")
    )
    rows = files.select("path", "toks", "own", F.posexplode_outer("own").alias("nth", "pos")).where(
        F.col("pos").isNotNull()
    )

    def place(offset: int) -> Column:
        return F.get("own", F.col("nth") + offset)

    rows = rows.select(
        "path",
        "toks",
        "pos",
        F.get("toks", F.col("pos")).alias("tok"),
        (F.coalesce(place(-1), F.lit(-1)) + 1).alias("since"),
        *(F.get("toks", place(k)).alias(n) for n, k in {"p1": -1, "p2": -2, "p3": -3, "n1": 1}.items()),
    )
    pos, tok, n1 = F.col("pos"), F.col("tok"), F.col("n1")
    # Line breaks of the blanks and comments before the token.
    passed = F.array_join(F.slice("toks", F.col("since") + 1, pos - F.col("since")), "")
    rows = rows.select(
        "*",
        F.when(F.col("since") < pos, newlines(passed)).otherwise(0).alias("skipped"),
        F.when(tok.contains("\n"), newlines(tok)).otherwise(0).alias("nl"),
    ).where(
        tok.isin("(", ")", "[", "]", "{", "}", ";", "<", ">", *RUST_WORDS)
        | n1.eqNullSafe("(")
        | F.col("p1").eqNullSafe("fn")
        | (F.col("nl") + F.col("skipped") > 0)
    )
    rows = rows.select(
        "path",
        "pos",
        "tok",
        _ahead("rust", tok).alias("ahead"),
        "skipped",
        "nl",
        *("p1", "p2", "p3", "n1"),
        F.when(n1 == "(", is_name(tok)).alias("named"),
        F.when(tok.isin(*RUST_WORDS), is_name(n1)).alias("n1_named"),
        F.when(F.col("p1") == "!", is_name(F.col("p2"))).alias("p2_named"),
    )
    opens, closes = tok.isin("(", "[", "{"), tok.isin(")", "]", "}")

    def running(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before_row()), F.lit(0)).cast("int")

    placed = rows.select(
        "*",
        (running(F.col("nl") + F.col("skipped")) + F.col("skipped") + 1).alias("line"),
        (running(F.when(opens, 1).when(closes, -1).otherwise(0)) - closes.cast("int")).alias("depth"),
        running(F.when(tok == "<", 1).when(tok == ">", -1).otherwise(0)).alias("angle"),
    )
    return placed.withColumn("end_line", F.col("line") + F.col("nl")).drop("nl", "skipped")


# The words that a rule looks for, of the languages whose other tokens are left out.
_WORDS = {
    "typescript": ("class", "function", "import", "export", "@", "<", ">"),
    "go": ("func", "type", "var", "const", "import", "struct", "interface"),
}


def _read_later(lang: str) -> Column:
    """Whether a rule reads a token itself, not only as a neighbour of another one."""
    tok, p1, n1 = F.col("tok"), F.col("p1"), F.col("n1")
    read = tok.isin("(", ")", "[", "]", "{", "}", ";", *_WORDS[lang]) | n1.eqNullSafe("(")
    if lang == "typescript":
        # Those with an equals sign bound type arguments.
        return read | n1.isin("<", "?.") | p1.isin("from", "import") | tok.contains("=")
    return read | (p1 == "import") | (F.col("p2") == "import") | ((n1 == "[") & F.col("named"))


def significant(sources: DataFrame, lang: str, parts: int) -> DataFrame:
    """The tokens of one language that carry meaning, each with its place and its neighbours.

    Added columns: ``line`` and ``end_line``; ``depth`` (brackets open around the token; a bracket
    has the depth of its pair); ``angle`` (running ``<`` minus ``>``); ``named`` (identifier or
    keyword); ``p1 p2`` and ``n1 n2`` the neighbours (further ones where a language needs them);
    ``breaks`` a line break before; ``fresh`` and ``margin`` for tokens that start a logical line;
    ``ahead`` the tokens from a possible declaration on. Of TypeScript and Go only the tokens that a
    rule reads are returned, of Rust see :func:`_telling`; its facts are read by ``rust``, file by file.
    """
    if lang == "rust":
        return _telling(sources, parts)
    tok, python = F.col("tok"), lang == "python"
    trivia = is_trivia(tok, lang)
    rows = _exploded(sources, lang, parts).select(
        "path",
        "pos",
        "tok",
        _ahead(lang, tok).alias("ahead"),
        F.when(tok.contains("\n"), newlines(tok)).otherwise(0).alias("nl"),
        is_name(tok).alias("named"),
        trivia.alias("trivia"),
    ).where(~F.col("trivia") | (F.col("nl") > 0))
    opens, closes = tok.isin("(", "[", "{"), tok.isin(")", "]", "}")
    here, earlier = in_order(), before_row()

    def running(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("int")

    placed = rows.select(
        "*",
        running(F.col("nl")).alias("lines_before"),
        running(F.when(opens, 1).when(closes, -1).otherwise(interpolation(tok, lang))).alias("open_before"),
        running(F.when(tok == "<", 1).when(tok == ">", -1).otherwise(0)).alias("angle"),
        F.lag("tok").over(here).alias("raw_before"),
    ).where(~F.col("trivia"))
    raw = F.col("raw_before")
    margin = F.substring_index(raw, "\n", -1)
    width = F.length(margin) + 7 * (F.length(margin) - F.length(F.translate(margin, "\t", "")))
    breaks = raw.isNull() | (raw.contains("\n") & is_blank(raw))
    placed = placed.select(
        "path",
        "pos",
        "tok",
        "ahead",
        "named",
        (F.col("lines_before") + 1).alias("line"),
        (F.col("lines_before") + 1 + F.col("nl")).alias("end_line"),
        (F.col("open_before") - closes.cast("int")).alias("depth"),
        "angle",
        breaks.alias("breaks"),
        (F.when(raw.isNull(), 0).otherwise(width) if python else F.lit(0)).alias("margin"),
        (
            (F.col("open_before") == 0) & breaks & ~closes if python else F.lit(False)
        ).alias("fresh"),
    )
    near = {
        "p1": F.lag("tok", 1),
        "p2": F.lag("tok", 2),
        "n1": F.lead("tok", 1),
        "n2": F.lead("tok", 2),
        "p1_named": F.lag("named", 1),
        "n1_named": F.lead("named", 1),
        "p1_line": F.lag("line", 1),
        "p1_end_line": F.lag("end_line", 1),
        "n1_line": F.lead("line", 1),
    }
    if python:
        near |= {"n1_fresh": F.lead("fresh", 1)}
    if lang == "go":
        near |= {
            "n3": F.lead("tok", 3),
            "n3_named": F.lead("named", 3),
            "n4": F.lead("tok", 4),
            "p1_breaks": F.lag("breaks", 1),
        }
    rows = placed.select("*", *[c.over(here).alias(n) for n, c in near.items()])
    if lang in _WORDS:
        rows = rows.where(_read_later(lang))
    return _generic_calls(rows) if lang == "typescript" else rows.withColumn("generic", F.lit(False))
