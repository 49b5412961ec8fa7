"""One regular expression per language that splits a text into tokens.

Each covers every character, so the tokens of a file joined together give the file again. Strings
and comments are single tokens, but for strings with interpolations: the text up to an expression
is one token (it ends with the opening brace), the expression is lexed as code, and the text from
its closing brace on is the next one. Groups of alternatives repeat possessively, which the regex
engine does in a loop; other forms would recurse once per round. A string ends at the first closing
quote that an even number of backslashes precedes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EVEN = r"(?<!\\)(?:\\\\)*+"
_LINE_END = r"(?<!\\\r)(?=\r?\n)"
_BLANK = r"[\s\x{FEFF}]++"
_IDENT = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_NUMBER = r"\p{Nd}\w*+(?:\.\p{Nd}\w*+)?+"
_ANY = r"[\s\S]"
_SLASH_COMMENT = r"//[^\r\n]*+"
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"

#: Depth to which block comments of Rust may hold each other.
COMMENT_DEPTH = 12


def _nested_comment() -> str:
    plain = r"[^*/]|\*(?!/)|/(?!\*)"
    inner = rf"/\*(?:{plain})*+(?:\*/|\z)"
    for _ in range(COMMENT_DEPTH - 1):
        inner = rf"/\*(?:{plain}|{inner})*+(?:\*/|\z)"
    return inner


def _one_line_string(quote: str) -> str:
    """Ends at its quote, or unclosed at the end of the line; a backslash continues the line."""
    return rf"{quote}[\s\S]*?{_EVEN}(?:{quote}|{_LINE_END}|\z)"


def _long_string(open_: str, close: str | None = None) -> str:
    return rf"{open_}[\s\S]*?{_EVEN}(?:{close or open_}|\z)"


_TRIPLE = '"""'

LEXIS: dict[str, str] = {
    "python": "|".join(
        [
            r"(?:[rRbBuUfFtT]{1,2}(?=[\"']))?+(?:"
            + "|".join([_long_string(_TRIPLE), _long_string("'''"), _one_line_string('"'), _one_line_string("'")])
            + ")",
            r"#[^\r\n]*+",
            r"\\\r?\n",
            _BLANK, _IDENT, _NUMBER, r"->|:=|==|!=", _ANY,
        ]
    ),
    "typescript": "|".join(
        [
            _one_line_string('"'), _one_line_string("'"), _long_string("`"),
            _SLASH_COMMENT, _BLOCK_COMMENT,
            # A regular expression stands where an operand may start; it takes the blanks before it.
            r"(?<=[=(,:;!&|?\[{]|\breturn)[ \t\r\n]*+"
            r"/(?![/*])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/[a-z]*+",
            _BLANK, "#?" + _IDENT, _NUMBER, r"=>|\?\.(?!\d)|<=|>=|===?|!==?|&&|\|\||\?\?", _ANY,
        ]
    ),
    "rust": "|".join(
        [
            r'(?:[bc]?r(#{0,255})"[\s\S]*?(?:"\1|\z))',
            "[bc]?+" + _long_string('"'),
            r"b?'(?:[^'\\\r\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|[^ux\r\n]))'",
            r"'[\p{L}_]\w*+",
            _SLASH_COMMENT, _nested_comment(),
            _BLANK, "(?:r#)?+" + _IDENT, _NUMBER, r"->|=>|::|<=|>=|==|!=|&&|\|\||\.\.", _ANY,
        ]
    ),
    "go": "|".join(
        [
            _one_line_string('"'), r"`[^`]*+(?:`|\z)",
            r"'(?:[^'\\\r\n]|\\[^\r\n][^'\r\n]{0,10})'",
            _SLASH_COMMENT, _BLOCK_COMMENT,
            _BLANK, _IDENT, _NUMBER, r":=|<-|<=|>=|==|!=|&&|\|\|", _ANY,
        ]
    ),
}


# How a string with interpolations starts, and how its text goes on behind one. In Python a brace
# in the text is doubled, so a single one belongs to code; in a template string the text may hold
# closing braces.
_INTERPOLATED = {
    "python": (
        r"^(?:[fFtT][rR]?|[rR][fFtT])[\"'](?:[^{]|\{\{)*+\{(?!\{)",
        r"\A[a-zA-Z]{1,2}[\"'](?:[^{]|\{\{)*+\{|\}(?:[^{}]|\{\{|\}\})*+(?:\{|\z)",
    ),
    "typescript": (
        r"^`(?:[^$\\]|\\[\s\S]|\$(?!\{))*+\$\{",
        r"\A`(?:[^$\\]|\\[\s\S]|\$(?!\{))*+\$\{|\}(?:[^$\\]|\\[\s\S]|\$(?!\{))*+(?:\$\{|\z)",
    ),
}


def lex(text: Column, lang: str) -> Column:
    """Array of the tokens of ``text``."""
    toks = F.regexp_extract_all(text, F.lit(LEXIS[lang]), F.lit(0))
    if lang not in _INTERPOLATED:
        return toks
    start, parts = _INTERPOLATED[lang]
    inner = F.lit(f"{parts}|{LEXIS[lang]}")

    def opened(tok: Column) -> Column:
        held = tok.contains("{") & tok.rlike(start)
        return F.when(held, F.regexp_extract_all(tok, inner, F.lit(0))).otherwise(F.array(tok))

    return F.flatten(F.transform(toks, opened))


def interpolation(tok: Column, lang: str) -> Column:
    """1 for the text before a string's first expression, -1 for that behind its last, else 0."""
    if lang not in _INTERPOLATED:
        return F.lit(0)
    closes = tok.startswith("}") & (F.length(tok) > 1)
    if lang == "python":
        opens = tok.endswith("{") & tok.rlike(r"^(?:[a-zA-Z]{1,2}[\"']|\}.)")
    else:
        opens = tok.endswith("${") & (tok.startswith("`") | closes)
    return F.when(opens & ~closes, 1).when(closes & ~opens, -1).otherwise(0)


def newlines(tok: Column) -> Column:
    return F.length(tok) - F.length(F.translate(tok, "\n", ""))


def is_blank(tok: Column) -> Column:
    # Ends at the first other character.
    return F.ltrim(tok, F.lit(" \t\r\n\f﻿")) == ""


def is_comment(tok: Column, lang: str) -> Column:
    if lang == "python":
        return tok.startswith("#")
    return tok.startswith("//") | tok.startswith("/*")


def is_trivia(tok: Column, lang: str) -> Column:
    """Blanks, comments and, in Python, a line break that a backslash hides."""
    trivia = is_blank(tok) | is_comment(tok, lang)
    return trivia | tok.rlike(r"^\\\r?\n") if lang == "python" else trivia


def is_name(tok: Column) -> Column:
    """An identifier or keyword, not a string with a letter prefix."""
    return tok.rlike(r"^(?:r#)?[\p{L}_$][\p{L}\p{N}_$]*$")


def is_string(tok: Column) -> Column:
    return tok.rlike("^[A-Za-z]{0,2}[\"'`]")


def opens_string(tok: Column, lang: str) -> Column:
    """A literal in quotes of any kind, or of an interpolated one the text before its first expression."""
    quoted = tok.rlike("^[A-Za-z]{0,2}#*[\"'`]")
    # A lifetime has an opening quote only.
    return quoted & ~tok.rlike(r"^'[\p{L}_]\w*$") if lang == "rust" else quoted
