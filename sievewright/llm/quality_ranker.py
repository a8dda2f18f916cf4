"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 over one labelled 0) teach a linear score
of text features: logistic loss on the difference of the two feature vectors.
The threshold is the quantile of the learned scores at the share of label 0, and
scores are mapped to 0..1 so that the threshold falls on ``cut``.

Learning uses at most ``max_labels`` labelled rows (the first by a hash of the id)
and ``max_pairs`` pairs, on the driver; that bounds what is collected whatever the
corpus. Scoring is a projection over the feature expressions, without Python.

Defined cases: null labels and held-out rows are not learned from; if either label
is missing there is nothing to rank, weights are 0 and every score is ``cut``;
null and empty texts have all-zero counts and get a score like any other; null
ids are carried; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .features import text_features

#: Features as SQL over the counts.
FEATURES = {
    "symbols": "ln(1 + 20.0 * n_symbols / greatest(n_words, 1))",
    "upper": "1.0D * n_upper / greatest(n_letters, 1)",
    "repeats": "1.0D * n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "ln(1D + n_dup_lines)",
    "stop_words": "1.0D * n_stop / greatest(n_words, 1)",
    "bangs": "ln(1 + 20.0 * n_bang / greatest(n_words, 1))",
    "word_length": "ln(1 + 1.0D * word_chars / greatest(n_words, 1))",
    "variety": "1.0D * n_distinct / greatest(n_words, 1)",
    "length": "ln(1D + n_words)",
}


class PairwiseRanker:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cut: float):
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, cut: float = 0.7, max_pairs: int = 40_000, l2: float = 1e-3, steps: int = 300, seed: int = 7) -> PairwiseRanker:
        d = len(FEATURES)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return cls(np.zeros(d), np.ones(d), np.zeros(d), 0.0, cut)
        mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - mean) / scale
        rng = np.random.default_rng(seed)
        n = min(max_pairs, len(good) * len(bad))
        diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
        w, velocity = np.zeros(d), np.zeros(d)
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(0) + l2 * w
            velocity = 0.9 * velocity - 0.3 * grad
            w = w + velocity
        scores = z @ w
        return cls(mean, scale, w, float(np.quantile(scores, len(bad) / len(y), method="midpoint")), cut)

    def score(self) -> Column:
        """0..1 and rising with the learned score; the threshold maps to ``cut``."""
        margin = F.lit(math.log(self.cut / (1 - self.cut)) - self.threshold)
        for sql, m, s, w in zip(FEATURES.values(), self.mean, self.scale, self.weights, strict=True):
            margin = margin + (F.expr(sql).cast("double") - float(m)) * float(w / s)
        return 1 / (1 + F.exp(-margin))


def fit_ranker(documents: DataFrame, labels: DataFrame, *, max_labels: int = 6000, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PairwiseRanker:
    """Learn from the labelled rows that aren't held out."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("sw_y")).where("sw_y IN (0, 1) AND doc_id IS NOT NULL")
    sample = rows.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "sw_y").limit(max_labels)
    known = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The sample has at most max_labels rows of two numbers, so broadcasting it is bounded.
    found = text_features(known.join(F.broadcast(sample), "doc_id"), extra=("sw_y",))
    values = found.select("sw_y", *(F.expr(sql).cast("double").alias(k) for k, sql in FEATURES.items())).orderBy("doc_id", "sw_y").collect()
    x = np.array([list(r)[1:] for r in values], float).reshape(-1, len(FEATURES))
    return PairwiseRanker.fit(x, np.array([r[0] for r in values], int), cut=cut)


def score_quality(documents: DataFrame, ranker: PairwiseRanker, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every row, with the columns of ``extra``."""
    counts = text_features(documents, id_col=id_col, text_col=text_col, extra=extra)
    scored = counts.select("doc_id", *extra, "n_words", ranker.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ranker.cut).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from labelled rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    ranker = fit_ranker(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents, ranker)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
