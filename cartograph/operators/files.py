"""Facts read file by file, in Python tasks: what the languages share.

A file is one cell of the source table, so nothing is sorted and memory holds one file's tokens.
"""

from __future__ import annotations

import gc
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
FACTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("path", _S), ("lang", _S), ("pos", _I), ("tok", _S), ("head", _S), ("name", _S), ("call", _B),
            ("imported", _B), ("stmt", _I), ("line", _I), ("start_line", _I), ("end_line", _I), ("start_pos", _I),
            ("end_pos", _I), ("open_pos", _I), ("close_pos", _I), ("params", _S), ("doc", _S), ("in_class", _B),
            ("top", _B),
        )
    ]
)
# The columns that differ between rows; the others are filled in for a whole batch.
OWN = ("path", "pos", "tok", "head", "name", "call", "imported", "stmt", "line", "start_line", "end_line", "start_pos",
       "end_pos", "open_pos", "close_pos", "params")
_PLACED = ("doc", "in_class", "top")
_ARROW = {f.name: {_S: pa.string(), _I: pa.int32(), _B: pa.bool_()}[f.dataType] for f in FACTS}

# The last position, of what has no end.
FAR = 2**31 - 1
BLANKS = " \t\r\n\f\ufeff"
# What a blank or comment starts with.
TRIVIA = frozenset(BLANKS + "/")


def class_of(kinds: str) -> str:
    """The characters whose category starts with one of ``kinds``, as the inside of a class."""
    found, first = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)).startswith(tuple(kinds.split()))
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            found.append(f"\\U{first:08x}-\\U{code - 1:08x}")
            first = None
    return "".join(found)


def is_trivia(tok: str) -> bool:
    """A blank or comment."""
    return tok[0] in TRIVIA and (not tok.lstrip(BLANKS) or tok[:2] in ("//", "/*"))


def before(toks: list[str], place: int) -> int:
    """The token that carries meaning before this one; -1 if none does."""
    place -= 1
    while place >= 0 and toks[place][0] in TRIVIA and is_trivia(toks[place]):
        place -= 1
    return place


def behind(toks: list[str], place: int) -> int | None:
    """The token that carries meaning behind this one, if one does."""
    place += 1
    while place < len(toks) and toks[place][0] in TRIVIA and is_trivia(toks[place]):
        place += 1
    return place if place < len(toks) else None


# Rows to a batch that goes back to Spark.
_ROWS = 5_000


def _batch(rows: list[tuple], lang: str) -> pa.RecordBatch:
    n = len(rows)
    columns = {
        "lang": pa.array([lang] * n, pa.string()),
        "doc": pa.nulls(n, pa.string()),
        "in_class": pa.array([False] * n, pa.bool_()),
        "top": pa.array([True] * n, pa.bool_()),
    }
    # Rows of Python have values of the last columns, too.
    columns |= {name: pa.array(values, _ARROW[name]) for name, values in zip(OWN + _PLACED, zip(*rows))}
    return pa.RecordBatch.from_arrays([columns[name] for name in FACTS.names], names=FACTS.names)


def _batches(read: Callable, lang: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # What is loaded by now stays; else each collection would pass over it again.
    gc.freeze()
    rows: list[tuple] = []
    for batch in batches:
        for path, text in zip(batch["path"], batch["content"]):
            if text.is_valid:
                rows += read(path.as_py(), text.as_py())
            if len(rows) >= _ROWS:
                yield _batch(rows, lang)
                rows = []
    if rows:
        yield _batch(rows, lang)


def read_facts(sources: DataFrame, read: Callable, lang: str) -> DataFrame:
    """The rows that ``read(path, text)`` finds in each file of ``(path, content)``; one without a text has none."""
    return sources.mapInArrow(partial(_batches, read, lang), FACTS)
