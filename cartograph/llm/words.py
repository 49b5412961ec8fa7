"""Vectorised word handling inside tasks: Arrow arrays in, numpy arrays out.

Every operator that works on words splits whole texts here. A batch is cut into slices of a few
megabytes of text, so what a task holds does not depend on how long the documents are; one
document is the smallest slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def byte_table(separators: list[tuple[int, int]], fold: bool) -> np.ndarray:
    """Byte map: the given ranges become spaces, A-Z become a-z if ``fold``."""
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[0x41:0x5B] += 0x20
    for low, high in separators:
        table[low : high + 1] = 0x20
    return table


#: Words are runs without ASCII white space.
SPACED = byte_table([(0x09, 0x0D), (0x20, 0x20)], fold=False)
SPACED_FOLDED = byte_table([(0x09, 0x0D), (0x20, 0x20)], fold=True)
#: Words are runs of ASCII letters, ASCII digits and all characters beyond ASCII.
ALNUM_FOLDED = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], fold=True)


class Words(NamedTuple):
    """Words of several documents: word ``i`` is ``distinct[codes[i]]``, document ``d`` has the
    words ``starts[d]`` to ``starts[d + 1]``."""

    codes: np.ndarray
    distinct: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        own = [xxhash.xxh64_intdigest(w) for w in self.distinct.cast(pa.binary()).to_pylist()]
        return np.array(own, dtype=np.uint64)[self.codes] if own else np.zeros(0, np.uint64)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null is the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    _, offsets, data = text.buffers()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    used = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return used, at - at[0]


def translate(text: pa.Array, table: np.ndarray) -> pa.Array:
    data, offsets = raw(text)
    return pa.StringArray.from_buffers(
        len(text), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(table[data].tobytes())
    )


def split_words(text: pa.Array, table: np.ndarray) -> Words:
    parts = pc.ascii_split_whitespace(translate(text, table))
    flat = parts.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = np.asarray(parts.offsets)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(
        np.asarray(coded.indices).astype(np.int64), coded.dictionary, before[offsets - offsets[0]]
    )


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores until no column has that name (names ignore case)."""
    taken = [x.lower() for x in taken]
    while wish.lower() in taken:
        wish += "_"
    return wish


def map_slices(
    frame: DataFrame,
    column: str,
    work: Callable[[pa.RecordBatch], dict | None],
    schema: T.StructType,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` on every slice; it returns columns in the order of ``schema``, of any length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                made = work(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [_typed(x, f.type) for x, f in zip(made.values(), arrow, strict=True)],
                        schema=arrow,
                    )

    return frame.mapInArrow(run, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)
