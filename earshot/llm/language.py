"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, in_small_batches

UNDETERMINED = "und"
#: n-grams gathered at a time while a text is scored; bounds memory, not the text.
CHUNK = 1 << 18
#: Bytes of the matrix of ``buckets`` by languages, single floats; with more languages learning is refused, none is dropped.
MAX_MODEL_BYTES = 128 << 20
#: Buckets whose logarithms are widened to double floats at a time.
WIDENED = 1024


def gram_buckets(text: str, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the character n-grams of the lower-cased text, in chunks.

    Runs of white space count as one blank, and the text is framed by blanks.
    """
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for n in orders:
        for at in range(0, len(codes) - n + 1, CHUNK):
            window = codes[at : min(len(codes), at + CHUNK + n - 1)]
            width = len(window) - n + 1
            h = np.full(width, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for j in range(n):
                h = (h ^ window[j : j + width]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            yield (h % np.uint64(buckets)).astype(np.int32)


def _count(orders: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                own = total.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                for found in gram_buckets(text.as_py(), orders, buckets):
                    own += np.bincount(found, minlength=buckets)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], rows[lang]))], ["lang", "bucket", "n"]
            )

    return run


def language_scores(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    orders: tuple[int, ...] = (1, 2, 3),
    buckets: int = 1 << 14,
    alpha: float = 0.1,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``.

    Learns from every row outside fold 0 whose text and language are set. ``score`` is the posterior of
    the predicted language given equal n-gram evidence; ties go to the language first in order.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language
    was learned. The counts are summed by Spark; the driver holds and broadcasts the matrix, ``buckets``
    times the number of languages: MAX_MODEL_BYTES at most (2048 languages), more languages raise.
    """
    held = fold_of(id_col, folds) == 0
    taught = in_small_batches(docs).where(~held & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counted = (
        taught.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(_count(orders, buckets), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    )
    learned = {}
    for r in counted.toLocalIterator():
        learned[r.lang] = (np.array([c.bucket for c in r.cells]), np.array([c.n for c in r.cells], dtype=np.float64))
        if 4 * buckets * len(learned) > MAX_MODEL_BYTES:
            raise ValueError(f"{len(learned)} languages take more than {MAX_MODEL_BYTES} bytes; use fewer buckets")
    langs = sorted(learned)
    logs = np.zeros((buckets, len(langs)), np.float32)
    prior = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        at, n = learned[lang]
        prior[i] = n[0]  # bucket -1: rows of the language
        full = np.full(buckets, alpha)
        full[at[1:]] += n[1:]
        logs[:, i] = np.log(full / full.sum())
    prior = np.log(prior / prior.sum()) if len(langs) else prior
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            preds, scores = [], []
            for x in b.column(1):
                text = x.as_py()
                if text is None or not langs or not any(map(str.isalpha, text)):
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = prior.copy()
                for found in gram_buckets(text, orders, buckets):
                    if len(found) < buckets // 4:
                        total += table[found].sum(0, dtype=np.float64)
                    else:
                        n = np.bincount(found, minlength=buckets)
                        for at in range(0, buckets, WIDENED):
                            total += n[at : at + WIDENED] @ table[at : at + WIDENED].astype(np.float64)
                best = int(total.argmax())
                preds.append(langs[best])
                scores.append(float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
