"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts are transformed towards normal shape and scaled. Per class, the mean and a
covariance shrunk towards the pooled one and towards a multiple of the identity are fitted from sums
over all training rows (counts, sums and products, added up by Spark; nothing is sampled). A score is
the logistic of the difference of the classes' Mahalanobis log-densities, with the inverses of the
Cholesky factors kept in the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import written

FEATURES = ("log_chars", "word_length", "word_length_spread", "upper", "symbols", "digits", "odd_ends", "lone_marks",
            "distinct_words", "repeated_neighbours", "repeated_runs", "repeated_lines", "top_word", "entropy",
            "sentence_length", "short_words")
POOLED, SPHERICAL = 0.2, 0.05  # shrinkage towards the pooled covariance and towards the identity


def _logit(part: float, whole: float) -> float:
    """Log-odds of a share, with half a case added to either side."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics FEATURES of a text; those of an empty text are finite too."""
    words, chars = text.split(), len(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    alpha = digits = upper = space = 0
    for c, k in Counter(text).items():
        if c.isalpha():
            alpha += k
            if c.isupper():
                upper += k
        elif c.isspace():
            space += k
        elif c.isdigit():
            digits += k
    symbols = chars - alpha - space - digits
    odd = sum(k for w, k in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:?'\")"))
    lone = sum(k for w, k in counts.items() if not any(map(str.isalnum, w)))
    neighbours = sum(a == b for a, b in zip(words, words[1:], strict=False))
    runs = max(n - 4, 0)
    repeated_runs = runs - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    lines = [s for s in text.split("\n") if s.strip()]
    repeated_lines = len(lines) - len(set(lines))
    p = np.array(list(counts.values()), float) / n if n else np.ones(1)
    entropy = -(p * np.log(p)).sum() / math.log(n + 1) if n else 0.0
    ends = sum(k for w, k in counts.items() if w[-1] in ".!?")
    short = sum(k for w, k in counts.items() if len(w) <= 3)
    return [math.log1p(chars), math.log1p(lengths.mean()), math.log1p(lengths.std()), _logit(upper, alpha),
            _logit(symbols, chars), _logit(digits, chars), _logit(odd, n), _logit(lone, n), _logit(len(counts), n),
            _logit(neighbours, max(n - 1, 0)), _logit(repeated_runs, runs), _logit(repeated_lines, len(lines)),
            _logit(max(counts.values(), default=0), n), entropy, math.log((n + 1) / (ends + 1)), _logit(short, n)]


def document_statistics(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): one row per row of ``documents``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                            F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Scaling, and per class the prior, mean, inverse Cholesky factor and log-determinant."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if not self.means:
            return np.full(len(x), 1 / (1 + math.exp(-float(self.log_prior[1] - self.log_prior[0]))))
        z = (x - self.centre) / self.scale
        density = [p - 0.5 * (((z - m) @ w.T) ** 2).sum(1) - d
                   for p, m, w, d in zip(self.log_prior, self.means, self.whiten, self.log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def fit(training: DataFrame, pooled: float = POOLED, spherical: float = SPHERICAL) -> Model:
    """Model of a table (x, label) with label 0 or 1; other labels and nulls take no part.

    Without two rows of either class the model gives the share of class 1, 0.5 if there is no row.
    """
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            y = b.column("label").to_numpy()
            x = np.c_[np.ones(len(x)), x]
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "value"])

    used = training.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label"))
    sums = np.zeros(2 * (d + 1) ** 2)
    for r in used.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[r["at"]] = r["value"]
    sums = sums.reshape(2, d + 1, d + 1)
    n = sums[:, 0, 0]
    log_prior = np.log((n + 0.5) / (n.sum() + 1))
    if n.min() < 2:
        return Model(np.zeros(d), np.ones(d), log_prior, [], [], np.zeros(2))
    centre = sums[:, 0, 1:].sum(0) / n.sum()
    second = sums[:, 1:, 1:].sum(0) / n.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), 1e-6))
    means = [(sums[c, 0, 1:] / n[c] - centre) / scale for c in (0, 1)]
    covs = [(sums[c, 1:, 1:] / n[c] - np.outer(sums[c, 0, 1:], sums[c, 0, 1:]) / n[c] ** 2) / np.outer(scale, scale)
            for c in (0, 1)]
    common = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    whiten, log_det = [], []
    for s in covs:
        s = (1 - pooled - spherical) * s + pooled * common
        s = s + (spherical * max(np.trace(s) / d, 1e-3)) * np.eye(d)
        factor = np.linalg.cholesky((s + s.T) / 2)
        whiten.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Model(centre, scale, log_prior, means, whiten, np.array(log_det))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold that learning leaves out; a null id is learnt from by none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """Statistics and labels of the rows outside the held-out fold; a repeated label row counts as often."""
    y = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
    return stats.join(y.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))), "doc_id").select("x", "label")


def score_quality(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for each row of ``documents``.

    Only texts are inputs of a score. Null and empty texts are scored by their statistics. Null and
    repeated ids are kept, row by row (a null id counts as held out). Without labels every score is
    0.5. An empty table gives an empty result; other columns are not read.
    """
    stats = written(document_statistics(documents, id_col, text_col), "statistics")
    model = fit(training_rows(stats, labels, label_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, that the classifier takes for class 1.

    Rows are scored where they stand, so repeated or null ids need no join back.
    """
    stats = document_statistics(documents, id_col, text_col)
    model = fit(training_rows(stats, labels, label_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or "") for t in b.column(text_col)]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.scores(x) >= 0.5))

    return documents.mapInArrow(run, documents.schema)
