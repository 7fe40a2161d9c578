"""Gathering the rows of a task into blocks that numpy can work on as a whole."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What a row counts beside its text, so that empty texts fill a block too.
ROW_CHARS = 64


def batched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, ...]]:
    """The columns of all rows in lists, cut once the texts in column 1 pass ``limit`` characters, with ROW_CHARS for each row.

    A text is never split; a single longer text makes a block of its own.
    """
    held: list[list] = []
    size = 0
    for b in batches:
        held = held or [[] for _ in b.columns]
        for row in zip(*(c for c in b.columns)):
            values = [x.as_py() for x in row]
            for column, v in zip(held, values):
                column.append(v)
            size += len(values[1] or "") + ROW_CHARS
            if size >= limit:
                yield tuple(held)
                held, size = [[] for _ in b.columns], 0
                give_back()
    if held and held[0]:
        yield tuple(held)
    give_back()


def give_back() -> None:
    """Free memory back to the system: a Python worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call elsewhere
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest width, byte planes apart, compressed."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(planes.tobytes())


def expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").ravel().astype(np.int64)


def by_block(rows: DataFrame, *columns: str, into: str) -> DataFrame:
    """What a block is told by the shards it has asked: a row for each block."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(into))
