"""Media columns: bytes kept in progressive JPEG files, and files read back to full-resolution tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import in_small_batches

#: Payload bytes written, and file bytes read, at a time; bounds memory, no file is split.
WRITE_BYTES, READ_BYTES = 256 << 10, 1 << 20
#: Side of a picture at most, a limit of the format.
MAX_SIDE = 65535


def _chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for at in _chunks([len(x) for x in texts], WRITE_BYTES):
            payloads = [x + bytes(-len(x) % 64 if x else 64) for x in texts[at]]
            if any(16 * max(jpeg.shape_of(len(p) // 64)) > MAX_SIDE for p in payloads):
                raise ValueError(f"a text is too long for a picture of {MAX_SIDE} pixels a side")
            files = jpeg.write_payloads(payloads)
            sizes = pa.array([len(x) for x in texts[at]], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0)[at], sizes, pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zeros up to a multiple of 64, as a progressive JPEG.

    Null texts are empty; an empty text is 64 zero bytes. Equal texts give equal files. Ids are cast to long;
    one that is not a whole number raises. A text is one picture and is never split: a task needs about forty
    times its bytes, Spark's values end at 2 GB, and a text too long for the format (6 GB) raises.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("raw")).mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def picture_features(rgb: np.ndarray) -> str:
    """Size, mean colour, eight-bin histogram of brightness and 64-bit difference hash of a tensor (height, width, 3).

    Brightness is (299 R + 587 G + 114 B) / 1000, rounded down. The hash compares the mean brightness of
    neighbours in a grid of eight rows by nine columns, row by row, the first bit highest.
    """
    high, wide = rgb.shape[:2]
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) // (high * wide)
    weighed = rgb[..., 0] * np.uint32(299)
    weighed += rgb[..., 1] * np.uint32(587)
    weighed += rgb[..., 2] * np.uint32(114)
    bright = (weighed // np.uint32(1000)).astype(np.uint8)
    bins = np.bincount((bright >> 5).ravel(), minlength=8)
    rows, columns = np.arange(8) * high // 8, np.arange(9) * wide // 9
    cells = np.add.reduceat(np.add.reduceat(bright, rows, 0, dtype=np.int64), columns, 1)
    area = np.outer(np.diff(np.append(rows, high)), np.diff(np.append(columns, wide)))
    grid = cells // area
    hashed = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    return f"{wide}x{high} mean {','.join(map(str, mean))} bins {','.join(map(str, bins))} dhash {hashed}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column(2).to_pylist()
        for at in _chunks([len(x) for x in media], READ_BYTES):
            payloads, tensors = jpeg.read_payloads(media[at])
            columns = [pa.array(payloads, pa.binary()), *(pa.array([t.shape[d] for t in tensors], pa.int32()) for d in (1, 0)), pa.array([t.tobytes() for t in tensors], pa.binary())]
            columns.append(pa.array([picture_features(t) for t in tensors], pa.string()))
            yield pa.RecordBatch.from_arrays([*(c[at] for c in b.columns), *columns], ["doc_id", "n_bytes", "media", "payload", "width", "height", "rgb", "feature"])


def from_media(media: DataFrame) -> DataFrame:
    """``media`` with the payload read back, the picture as width, height and rgb (rows of RGB bytes), and its features."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, media binary, payload binary, width int, height int, rgb binary, feature string")
