"""String predicates with the semantics the lookups need."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_RAISE = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)


def ascii_fold(col: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def folded(text: str) -> str:
    """:func:`ascii_fold` of a literal."""
    return text.translate(_FOLD)


def like_ascii(col: Column, pattern: str) -> Column:
    """``LIKE`` that ignores ASCII case, keeps ``%`` and ``_`` live and has no escape character."""
    return ascii_fold(col).like(folded(pattern).replace("\\", "\\\\"))


def prefix_like(col: Column, prefix: str) -> Column:
    """``col LIKE prefix || '%'`` as in :func:`like_ascii`, with a bound the scan can use.

    Folding hides the column from min/max pruning. The wildcard-free head of the prefix gives a
    range that every match lies in, whatever its case, so that range is stated as well.
    """
    matches = like_ascii(col, prefix + "%")
    head = prefix.split("%")[0].split("_")[0]
    if not head:
        return matches
    low, high = head.translate(_RAISE), head.translate(_FOLD) + "\U0010ffff"
    return (col >= F.lit(low)) & (col <= F.lit(high)) & matches


def next_prefix(prefix: str) -> str | None:
    """The smallest text behind all that start with ``prefix``, by code points; none if there is none."""
    while prefix:
        last = ord(prefix[-1])
        if last < 0x10FFFF:
            # Surrogates are no characters of a text.
            return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
        prefix = prefix[:-1]
    return None


def folded_prefix_like(col: Column, prefix: str) -> Column:
    """:func:`prefix_like` of a column that is folded already: the range is exact up to a wildcard."""
    prefix = folded(prefix)
    head = prefix.split("%")[0].split("_")[0]
    test = col >= F.lit(head)
    if (end := next_prefix(head)) is not None:
        test = test & (col < F.lit(end))
    return test if head == prefix else test & like_ascii(col, prefix + "%")


def last_suffix(path: Column) -> Column:
    """Extension after the last dot of the file name; empty when there is none.

    A leading dot does not start an extension, so ``.py`` alone has none.
    """
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


# Extension -> language.
LANGUAGES = {
    "py": "python",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "typescript",
    "jsx": "typescript",
    "rs": "rust",
    "go": "go",
}


def language_of(path: Column) -> Column:
    """Language of a path, or null when the extension is not supported."""
    # One lookup, so that the expression cuts the extension once a row.
    names = F.create_map(*(F.lit(text) for pair in LANGUAGES.items() for text in pair))
    return F.try_element_at(names, last_suffix(path))
