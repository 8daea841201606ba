"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import shingle_set, word_hashes

#: The statistics, each transformed to be near to normal.
FEATURES = ("chars", "word_chars", "upper", "symbols", "symbol_words", "digits", "bars", "marks", "distinct", "top_word", "echo", "same_lines", "line_words")
#: Weight of the pooled covariance and of the scaled identity in each class covariance.
POOL, IDENTITY = 0.15, 0.02
_CLASSES: list[np.ndarray] = []
_LETTER, _UPPER, _DIGIT, _SPACE, _BAR, _MARK, _STOP, _OTHER = range(8)


def _classes() -> np.ndarray:
    if not _CLASSES:
        def kind(c: str) -> int:
            if c.isalpha():
                return _UPPER if c.isupper() else _LETTER
            if c.isdigit():
                return _DIGIT
            if c.isspace():
                return _SPACE
            return _BAR if c == "|" else _MARK if c in "!?" else _STOP if c in ".,;:'\"-()" else _OTHER

        _CLASSES.append(np.fromiter((kind(chr(i)) for i in range(0x110000)), np.uint8, 0x110000))
    return _CLASSES[0]


def _logit(part: float, whole: float) -> float:
    p = (part + 0.5) / (whole + 1.0)
    return math.log(p / (1 - p)) if p < 1 else math.log((part + 0.5) / 0.5)


def statistics(text: str | None, words: np.ndarray) -> list[float]:
    """FEATURES of a text; words: the hashes of its words. All are defined for empty texts."""
    text = text or ""
    kinds = np.zeros(8, np.int64)
    joint = 0
    for i in range(0, len(text), 1 << 18):
        kind = _classes()[np.frombuffer(text[i : i + (1 << 18)].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        kinds += np.bincount(kind, minlength=8)
        odd = (kind == _OTHER) | (kind == _MARK)
        joint += int((odd[1:] & odd[:-1]).sum())
    n, w = len(text), len(words)
    letters = int(kinds[_LETTER] + kinds[_UPPER])
    _, times = np.unique(words, return_counts=True)
    shingles = max(0, w - 2)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(n / max(1, w)),
        _logit(int(kinds[_UPPER]), letters),
        _logit(int(kinds[_OTHER]), n),
        _logit(joint, w),
        _logit(int(kinds[_DIGIT]), n),
        _logit(int(kinds[_BAR]), w),
        _logit(int(kinds[_MARK]), w),
        math.log((len(times) + 1) / (w + 1)) / math.log(w + 3),
        _logit(int(times.max()) if w else 0, w),
        _logit(shingles - len(shingle_set(words)) if shingles else 0, shingles),
        _logit(len(lines) - len(set(lines)), len(lines)),
        math.log1p(w / max(1, len(lines))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row, repeated ones too: doc_id and one double for each of FEATURES, from the whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            rows = [statistics(text[i].as_py(), words) for i, words in word_hashes(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=["doc_id", *FEATURES])

    fields = ", ".join(f"{name} double" for name in FEATURES)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id bigint, {fields}")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-density constants of classes 0 and 1; prior: log odds of class 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    prior: float

    def log_odds(self) -> Column:
        """The difference of the class log densities, plus the prior, as a Column over FEATURES."""
        sides = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            away = F.lit(0.0)
            for row in range(len(FEATURES)):
                z = F.lit(0.0)
                for col in range(row + 1):
                    z = z + F.lit(float(factor[row, col])) * (F.col(FEATURES[col]) - F.lit(float(mean[col])))
                away = away + z * z
            sides.append(F.lit(constant) - away / 2)
        return sides[1] - sides[0] + F.lit(self.prior)


def fit(rows: DataFrame, label_col: str) -> Discriminant | float:
    """The discriminant of rows (FEATURES, label 0 or 1); the share of label 1, 0.5 without rows, if a class has under two rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)]
    cross = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i, j in pairs]
    by = {int(r["y"]): r for r in rows.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count("*").alias("n"), *sums, *cross).collect()}
    n = [by[k]["n"] if k in by else 0 for k in (0, 1)]
    if min(n) < 2:
        return n[1] / sum(n) if sum(n) else 0.5
    means, covs = [], []
    for k in (0, 1):
        mean = np.array([by[k][f"s{i}"] for i in range(d)]) / n[k]
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = by[k][f"c{i}_{j}"] / n[k] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    factors, constants = [], []
    for cov in covs:
        whole = (1 - POOL) * cov + POOL * pooled
        whole = (1 - IDENTITY) * whole + np.eye(d) * (IDENTITY * max(np.trace(whole) / d, 1e-6))
        lower = np.linalg.cholesky(whole)
        factors.append(np.linalg.inv(lower))
        constants.append(float(-np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(constants), math.log(n[1] / n[0]))


def score(rows: DataFrame, model: Discriminant | float) -> Column:
    """Probability of label 1, from 0 to 1, as a Column over FEATURES."""
    if isinstance(model, float):
        return F.lit(model)
    odds = model.log_odds()
    return F.when(odds >= 0, 1 / (1 + F.exp(-odds))).otherwise(F.exp(odds) / (1 + F.exp(odds)))
