"""Quality classifier (operator 10): regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics (lengths, character
and word shares, repetition). Each class has a mean and a covariance, shrunk
towards the pooled diagonal. The score is the logistic of the difference of the
two Gaussian log densities plus the log odds of the classes; Cholesky factors
are computed once and kept with the model.

Fitting adds up moments (numbers, sums, products) per class inside Spark and
brings only those few hundred numbers to the driver, so it uses every labelled
row at any size. Labels, language, source and id are never inputs of a score.

Contract: one row per document row; null and empty texts score as texts without
words; a document labelled more than once counts once, with its smallest label;
rows without a label or held out are not learned from; if a class has fewer
than two rows, every score is the share of label 1 (0.5 without labels).
Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.text import BYTE_VALUES, LOWER, SPACED, id_and_text, mix, run_sums, slices, span_hashes, word_spans

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digit", "stop", "symbol", "blank", "high", "line_words",
    "distinct_words", "repeated_lines", "next_same", "capitals", "marked_words", "short_words", "stop_ends",
]

_CLASS = np.zeros((256, 6), dtype=bool)
_CLASS[0x41:0x5B, 0] = True
_CLASS[0x30:0x3A, 1] = True
_CLASS[list(b".,;:?'\"()-"), 2] = True
_CLASS[list(b"#*$%&|<>!@^_=+~/\\{}[]`"), 3] = True
_CLASS[:, 4] = ~SPACED
_CLASS[0x80:, 5] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:?!")] = True
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text. Shares are variance-stabilised, lengths are logarithms."""
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    starts, ends, first = word_spans(data, offsets, SPACED)
    words = np.diff(first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    hashes = span_hashes(data, starts, ends, BYTE_VALUES[LOWER])
    owner = np.repeat(np.arange(docs), np.diff(first))
    line_starts, line_ends, line_first = word_spans(data, offsets, _LINE)
    lines = np.diff(line_first).astype(np.float64)
    line_hashes = span_hashes(data, line_starts, line_ends, BYTE_VALUES)
    line_owner = np.repeat(np.arange(docs), np.diff(line_first))

    def share(x, of):
        return np.arcsin(np.sqrt(np.clip(x / np.maximum(of, 1), 0, 1)))

    def distinct(values, owners):
        keys = np.unique(np.stack((mix(values + owners.astype(np.uint64)), owners.astype(np.uint64)), axis=1).view([("v", "u8"), ("o", "u8")]).reshape(-1)) if len(values) else np.zeros(0, dtype=[("v", "u8"), ("o", "u8")])
        return np.bincount(keys["o"].astype(np.int64), minlength=docs).astype(np.float64)

    counts = [run_sums(_CLASS[data, k], offsets).astype(np.float64) for k in range(6)]
    mean = run_sums(length, first) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(run_sums(length**2, first) / np.maximum(words, 1) - mean**2, 0))
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper_start = _CLASS[data[starts], 0]
    upper_second = upper_start & (length > 1) & _CLASS[data[np.minimum(starts + 1, max(len(data) - 1, 0))], 0]
    marked = _CLASS[data[ends - 1], 3]
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), *(share(c, size) for c in counts), np.log1p(words / np.maximum(lines, 1)),
        share(distinct(hashes, owner), words), share(lines - distinct(line_hashes, line_owner), lines), share(run_sums(same, first), words),
        share(run_sums(upper_second, first), words), share(run_sums(marked, first), words), share(run_sums(length <= 3, first), words), share(run_sums(_ENDS[data[ends - 1]], first), words),
    ])


@dataclass
class Discriminant:
    """Both classes' means, Cholesky factors of their covariances, and log odds; or a constant."""

    means: np.ndarray | None
    factors: np.ndarray | None
    log_odds: float

    @classmethod
    def from_moments(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float) -> "Discriminant":
        """n (2), sums (2, d) and products (2, d, d) of the two classes."""
        if n.min() < 2:
            odds = (n[1] + 1e-9) / (n[0] + 1e-9) if n.sum() else 1.0
            return cls(None, None, float(np.log(odds)))
        means = sums / n[:, None]
        scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.maximum(np.diagonal(scatter.sum(0)) / (n.sum() - 2), 1e-6))
        covariances = (1 - shrinkage) * scatter / (n - 1)[:, None, None] + shrinkage * pooled
        return cls(means, np.linalg.cholesky(covariances), float(np.log(n[1] / n[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        gap = np.full(len(x), self.log_odds)
        if self.means is not None:
            density = []
            for mean, factor in zip(self.means, self.factors):
                away = np.linalg.solve(factor, (x - mean).T)
                density.append(-0.5 * (away**2).sum(axis=0) - np.log(np.diagonal(factor)).sum())
            gap = gap + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def held_out_rows(id_column: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, id_column: str = "doc_id", text_column: str = "text") -> Discriminant:
    """Fit on all rows of `labels` (doc_id, quality) that are not held out, with `docs` texts."""
    d = len(FEATURES)
    triangle = np.triu_indices(d)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            flat = features(data, offsets).reshape(-1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * d, pa.int32()), pa.array(flat))], names=["doc_id", "x"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + len(triangle[0])))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            quality = batch.column("quality").to_numpy()
            for k in (0, 1):
                own = x[quality == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own)[triangle]))
        k, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(total.ravel())], names=["k", "place", "value"])

    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    told = told.filter(~held_out_rows()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Held-out texts need no vector; repeated document rows count as often as they are there.
    rows = id_and_text(docs, id_column, text_column).filter(F.col("doc_id").isNotNull() & ~held_out_rows())
    learned = rows.mapInArrow(vectors, "doc_id long, x array<double>").join(told, "doc_id").select("quality", "x")
    parts = learned.mapInArrow(moments, "k int, place int, value double").groupBy("k", "place").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 1 + d + len(triangle[0])))
    for row in parts.collect():
        total[row["k"], row["place"]] = row["value"]
    products = np.zeros((2, d, d))
    products[:, triangle[0], triangle[1]] = products[:, triangle[1], triangle[0]] = total[:, 1 + d :]
    return Discriminant.from_moments(total[:, 0], total[:, 1 : 1 + d], products, shrinkage)


def score_documents(docs: DataFrame, model: Discriminant, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: held_out, score (0 to 1, higher: label 1 likelier) and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            score = model.scores(features(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs, id_column, text_column).withColumn("held_out", held_out_rows())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, text_column):
            yield part.filter(pa.array(model.scores(features(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
