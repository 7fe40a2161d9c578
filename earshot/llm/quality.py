"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics. Each class has a mean and a covariance that
is shrunk towards its diagonal and towards the covariance pooled over classes; a score is the logistic of
the log-density difference, whose Mahalanobis terms use Cholesky factors computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import give_back
from .common import cut, fold_of, in_small_batches

#: Pipes, symbols and line ends tell navigation bars, tables and menus of scraped pages from prose; all are shares, none is a list of words.
FEATURES = [
    "log_words", "log_mean_word", "log_distinct", "logit_upper", "logit_digit", "logit_symbol", "logit_pipe",
    "logit_period", "logit_comma", "logit_repeat", "logit_top_word", "entropy", "logit_newline", "logit_capital",
]
_LOWER, _UPPER, _DIGIT = (np.array([chr(i) in s for i in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_SYMBOL = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,|" for i in range(256)])


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, with half a count added on both sides so that 0 and 1 stay finite."""
    part = min(part, whole)
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for a text; null counts as empty. Reads the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), len(raw)
    letters = size - int(counts[:65].sum())  # ASCII letters and everything beyond ASCII, roughly
    upper = int(counts[_UPPER].sum())
    p = counts[counts > 0] / max(size, 1)
    tally = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    capital = sum(65 <= w[0] <= 90 for w in words)
    return [
        math.log1p(n),
        math.log1p(sum(map(len, words)) / max(n, 1)),
        math.log((len(tally) + 1) / (n + 1)),
        _logit(upper, letters),
        _logit(int(counts[_DIGIT].sum()), size),
        _logit(int(counts[_SYMBOL].sum()), size),
        _logit(int(counts[124]), n),
        _logit(int(counts[46]), n),
        _logit(int(counts[44]), n),
        _logit(repeats, n),
        _logit(max(tally.values(), default=0), n),
        float(-(p * np.log2(p)).sum()),
        _logit(int(counts[10]), n),
        _logit(capital, n),
    ]


def featurised(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): one row per row of ``docs`` with its statistics as array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])
        give_back()

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the inverse form and log terms of the classes 0 and 1."""

    means: np.ndarray
    whiteners: np.ndarray
    logs: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        z = [self.logs[c] - 0.5 * (((x - self.means[c]) @ self.whiteners[c]) ** 2).sum(1) for c in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(z[0] - z[1], -700, 700)))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink_pooled: float, shrink_diagonal: float, ridge: float) -> Discriminant | float:
    """Discriminant from each class's count, sum and sum of outer products; a constant if a class is missing."""
    present = [c for c in (0, 1) if sums.get(c, (0,))[0] > 0]
    if len(present) < 2:
        return float(present[0]) if present else 0.5
    n = {c: sums[c][0] for c in present}
    means = {c: sums[c][1] / n[c] for c in present}
    covs = {c: sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in present}
    pooled = sum(n[c] * covs[c] for c in present) / sum(n.values())
    whiteners, logs = [], []
    for c in present:
        s = (1 - shrink_pooled) * covs[c] + shrink_pooled * pooled
        s = (1 - shrink_diagonal) * s + shrink_diagonal * np.diag(np.diag(s)) + ridge * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        whiteners.append(np.linalg.inv(factor).T)
        logs.append(math.log(n[c] / sum(n.values())) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array([means[c] for c in present]), np.array(whiteners), np.array(logs))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a partition: (label, n, position, value) of the sum and the upper outer products."""
    total: dict[int, list] = {}
    for b in batches:
        labels = np.array(b.column(1).to_pylist(), dtype=np.int64)
        x = np.array(b.column(0).to_pylist(), dtype=np.float64).reshape(len(labels), len(FEATURES))
        for c in np.unique(labels):
            own = x[labels == c]
            t = total.setdefault(int(c), [0, 0.0, 0.0])
            t[0] += len(own)
            t[1] = t[1] + own.sum(0)
            t[2] = t[2] + own.T @ own
    for c, (n, s, o) in total.items():
        values = np.concatenate([[n], s, o.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c)), pa.array(np.arange(len(values))), pa.array(values)], ["label", "at", "v"])


def learn(rows: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, folds: int, shrink_pooled: float, shrink_diagonal: float, ridge: float) -> Discriminant | float:
    """Discriminant from the labelled ones of ``rows`` (doc_id, x) outside fold 0; only sums leave the executors."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    taught = rows.where(fold_of("doc_id", folds) != 0).join(known, "doc_id").select("x", "y")
    parts = taught.mapInArrow(_sums, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    d = len(FEATURES)
    flat: dict[int, np.ndarray] = {}
    for r in parts.collect():  # at most two classes times the size of a covariance
        flat.setdefault(r.label, np.zeros(1 + d + d * d))[r["at"]] = r.v
    return fit({c: (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in flat.items()}, shrink_pooled, shrink_diagonal, ridge)


def _apply(model: Discriminant | float, x: list) -> np.ndarray:
    return np.full(len(x), model) if isinstance(model, float) else model.score(np.array(x, dtype=np.float64).reshape(len(x), len(FEATURES)))


#: Defaults: shares of the pooled covariance and of the diagonal, and what is added to variances.
SHRINKAGE = {"shrink_pooled": 0.05, "shrink_diagonal": 0.05, "ridge": 1e-3}


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
    **shrinkage: float,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Learns from every labelled row outside fold 0 of ``folds`` (crc32 of the id as text); no bound on
    their number. Only the text feeds a score. Null and empty texts have statistics like any other.
    Labels that are null or neither 0 nor 1 are left out; a document labelled twice counts twice. With
    one class learned the score is that class, with none 0.5.
    """
    rows = cut(featurised(docs, id_col=id_col, text_col=text_col))
    model = learn(rows, labels, id_col=id_col, label_col=label_col, folds=folds, **SHRINKAGE | shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_apply(model, b.column(1).to_pylist()))], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
    **shrinkage: float,
) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged; see quality_scores.

    Rows are judged where they are, so no text is shuffled and null or repeated ids do no harm.
    """
    rows = featurised(docs, id_col=id_col, text_col=text_col)
    model = learn(rows, labels, id_col=id_col, label_col=label_col, folds=folds, **SHRINKAGE | shrinkage)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(_apply(model, [statistics(t) for t in text]))

    return docs.where(score(F.col(text_col)) >= threshold)
