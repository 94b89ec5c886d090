"""Quality scores by Bradley-Terry pairwise ranking.

A document i is preferred to j with probability sigmoid(s_i - s_j), where s is a
weighted sum of features of the text. The weights are learnt from pairs of a good
and a bad document, by the logistic loss on the differences of their features. A
quantile of the scores then tells good from bad.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task_start

FEATURES = ["length", "word_length", "distinct", "top_word", "upper", "digit", "stop", "comma", "mark", "symbol", "line_length", "repeated_lines", "ended_words", "odd_words", "long_words", "same_neighbours"]
_CLASS = np.zeros(256, np.int64)  # of bytes: 1 upper, 2 digit, 3 . ? ; :, 4 comma, 5 !, 6 other ASCII signs, 7 letters and bytes over 127
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 7 if _b > 127 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in ".?;:" else 4 if _c == "," else 5 if _c == "!" else 0 if _b <= 32 else 6
_ENDS = tuple(".,;:?!")


def features(text: str | None) -> list[float]:
    """Numbers that describe a text, in the order of FEATURES; all 0 for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    data = text.encode()
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / len(data)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    ended = sum(w.endswith(_ENDS) for w in words)
    odd = sum(not w.rstrip(".,;:?!").isalnum() for w in words)
    return [
        float(np.log1p(n)),
        len(data) / n,
        len(counts) / n**0.85,
        max(counts.values()) / n,
        *map(float, kinds[1:7]),
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        ended / n,
        odd / n,
        sum(len(w) > 20 for w in words) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -700, 700)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Learns from `pairs` pairs of a good and a bad row. Without both kinds nothing is told apart: all scores are 0.5."""
    none = Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    if not good.any() or good.all():
        return none
    mean, scale = x.mean(0), x.std(0)
    ranker = Ranker(mean, np.where(scale > 1e-12, scale, 1), np.eye(len(FEATURES))[0], 0.0)
    z = np.clip((x - ranker.mean) / ranker.scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    ranker.weights = w
    s = ranker.raw(x)
    # The quantile of the scores that splits the labelled rows with the fewest errors; of equal ones the least.
    cuts = np.quantile(s, np.linspace(0, 1, 401)[1:-1], method="midpoint")
    errors = [(s[good] < c).mean() * good.sum() + (s[~good] >= c).sum() for c in cuts]
    ranker.threshold = float(cuts[int(np.argmin(errors))])
    return ranker


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 20_000, pairs: int = 200_000) -> Ranker:
    """Fits on the labelled rows whose crc32(doc_id as text) mod 3 is not 1; of more than `most`, on those of least hash.

    Labels with null ids or values are left out; an id with several labels counts
    as good if their mean is 0.5 or more. `most` bounds what reaches the driver: a
    row of features each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "good", "text")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            x = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = rows.mapInArrow(numbers, f"doc_id {id_type}, good boolean, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    good = np.array(table.column("good").to_pylist(), bool)
    order = np.lexsort((*x.T, good, np.array(table.column("doc_id").to_pylist())))  # the same, however rows arrive
    return fit(x[order], good[order], pairs)


def quality_scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, of whole texts.

    Null and empty texts have features of 0 and so one score; a null id is not
    held out. Repeated rows give repeated results, an empty table none; columns
    other than doc_id and text are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            s = ranker.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double, predicted int")
    return rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, with all their columns, whose score is 0.5 or more."""
    column = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_start()
        for batch in batches:
            x = np.array([features(t) for t in batch.column(column).to_pylist()], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(ranker.scores(x) >= 0.5))

    return docs.mapInArrow(good, docs.schema)
