"""Fixed schemas of the graph tables. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L = T.StringType(), T.LongType()

SOURCES = _table(("path", _S, False), ("content", _S, False))

SYMBOLS = _table(
    ("id", _S, False),
    ("name", _S, False),
    ("kind", _S, False),
    ("file_path", _S, False),
    ("line_start", _L, False),
    ("line_end", _L, False),
    ("signature", _S, True),
    ("docstring", _S, True),
    ("properties", _S, True),
)

RAW_EDGES = _table(
    ("source", _S, False), ("target", _S, False), ("kind", _S, False), ("file_path", _S, False)
)

# Every file that was indexed; a deleted one stays, so that a late older version is known as such.
FILES = _table(("path", _S, False), ("modified", _L, True), ("deleted", T.BooleanType(), False))

EDGES = _table(("source_id", _S, False), ("target_id", _S, False), ("kind", _S, False))

META = _table(("key", _S, False), ("value", _S, True))

# The symbol and edge kinds the tables accept.
SYMBOL_KINDS = ("function", "class", "method", "struct", "interface", "enum", "route")
EDGE_KINDS = ("calls", "imports", "inherits", "defines")
SCHEMA_VERSION = "1"

# Columns of every lookup and trace result.
ROW_COLUMNS = (
    "id",
    "name",
    "kind",
    "file_path",
    "line_start",
    "line_end",
    "signature",
    "docstring",
)
