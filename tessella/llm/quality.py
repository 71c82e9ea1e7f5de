"""Operator 6: document quality by Bradley-Terry ranking."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import slices, table
from tessella.llm.learning import judged, labelled_sample, labelled_scores, nth_least, remainder, score

OTHER = 9  # features besides the shares of the 256 byte values


def features(texts: list[str | None]) -> np.ndarray:
    """[text, feature] of whole texts: square roots of byte shares, and how words and lines repeat."""
    out = np.zeros((len(texts), 256 + OTHER), np.float32)
    for k, text in enumerate(texts):
        data = (text or "").encode()
        words, lines = data.split(), data.split(b"\n")
        n = max(1, len(words))
        out[k, :256] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data)))
        same = sum(map(eq, words, words[1:])) / n
        kinds = len(set(words)) / n
        out[k, 256:] = (
            np.log1p(n) / 10, kinds, np.sqrt(same), len(data) / n / 20, float(not words),
            np.sqrt(sum(w.isupper() for w in words) / n), np.sqrt(sum(len(w) == 1 for w in words) / n), len(set(lines)) / len(lines), np.log1p(len(lines)) / 10,
        )
    return out


class Ranking:
    """P(a is preferred to b) = sigmoid(s(a) - s(b)), s linear in standardised features."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int = 60_000, steps: int = 400, decay: float = 1e-4, seed: int = 5):
        """Learns from pairs of a document labelled 1 and one labelled 0; cut is the quantile of scores at the share of label 0."""
        x = x.astype(np.float64)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 0.02) if len(x) else (np.zeros(256 + OTHER), np.ones(256 + OTHER))
        z = (x - self.mean) / self.scale
        self.weights, self.cut = np.zeros(z.shape[1]), 0.0
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            return
        rng = np.random.default_rng(seed)
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            a, b = rng.choice(good, pairs // 60), rng.choice(bad, pairs // 60)
            d = z[a] - z[b]
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -40, 40)))  # of the wrong preference
            g = -(p @ d) / len(d) + decay * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weights -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        s = np.sort(z @ self.weights)
        at = len(bad)  # between the last score of that share and the next
        self.cut = float(s[at - 1] + s[min(at, len(s) - 1)]) / 2

    def strengths(self, texts: list[str | None]) -> np.ndarray:
        return ((features(texts) - self.mean) / self.scale) @ self.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(texts) - self.cut, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 5000, text: str = "text", doc_id: str = "doc_id") -> Ranking:
    """Learns weights from up to per_label labelled documents of either label, none of them held out (crc32 of the id mod 3 is 1).

    The cut is the quantile of the scores of all labelled documents that aren't held out, at their
    share of label 0: it doesn't depend on the sample's bound.
    """
    fold = remainder(doc_id, 3) != 1
    sample = labelled_sample(docs, labels, "quality", fold, per_label, text, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"x": [row.tobytes() for row in x], "label": b.column("label")})

    rows = sorted(sample.mapInArrow(run, "x binary, label int").collect())
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]) if rows else np.zeros((0, 256 + OTHER), np.float32)
    model = Ranking(x, np.array([r.label for r in rows]))
    if len({r.label for r in rows}) == 2:
        known = labelled_scores(docs, labels, "quality", fold, model.strengths, text, doc_id)
        n, bad = known.agg(F.count("*"), F.count_if(F.col("_label") == 0)).first()
        model.cut = (nth_least(known, "score", bad - 1) + nth_least(known, "score", min(bad, n - 1))) / 2
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = 5000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds score: 0 to 1, from 0.5 on as good as the better part of the labelled documents.

    Only text is an input. Null and empty texts are scored as texts without words. Without both
    labels in the sample every score is 0.5. Other columns stay; a column named score is replaced.
    """
    model = train(docs, labels, per_label, text, doc_id)
    return score(docs, lambda: model.scores, text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return judged(quality_scores(docs, table(spark, sf_dir, "labels")), 3, 1, 0.5)
