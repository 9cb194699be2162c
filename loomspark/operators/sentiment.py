"""Sentiment of texts: TF-IDF and logistic regression, fitted on a bounded sample, applied anywhere."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import by_slices
from .base import InvalidArgument, Parametric
from .models import _plain, driver_sample

_TERM = regex.compile(r"[\p{L}\p{N}]+")


@dataclass
class SentimentAnalyzer(Parametric):
    """fit(df with ``order``, text, label) on at most ``sample`` rows; predict adds prediction and score, the probability of the second label seen.

    The model holds one weight for each term of the sample, a size that the bound fixes. Null text counts as empty.
    """

    learning_rate: float = 0.1
    iterations: int = 300
    l2: float = 1e-3
    order: str = "row_id"
    sample: int = 3000

    def fit(self, df: DataFrame):
        rows = driver_sample(df, ["text", "label"], self.order, self.sample)
        labels = list(dict.fromkeys(rows["label"]))
        if len(labels) != 2:
            raise InvalidArgument("needs two labels")
        counts = [Counter(_TERM.findall((t or "").lower())) for t in rows["text"]]
        df_of = Counter(w for c in counts for w in c)
        vocabulary = sorted(df_of)
        at = {w: i for i, w in enumerate(vocabulary)}
        idf = np.array([math.log((1 + len(counts)) / (1 + df_of[w])) + 1 for w in vocabulary])
        row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        col = np.array([at[w] for c in counts for w in c], np.int64)
        val = np.array([n / sum(c.values()) for c in counts for n in c.values()]) * idf[col]
        y = np.array([float(x == labels[1]) for x in rows["label"]])
        w, b, n = np.zeros(len(vocabulary)), 0.0, len(y)
        for _ in range(self.iterations):
            e = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], n) + b, -60, 60))) - y
            w -= self.learning_rate * (np.bincount(col, val * e[row], len(w)) / n + self.l2 * w)
            b -= self.learning_rate * e.mean()
        return self._trained(weights=dict(zip(vocabulary, (w * idf).tolist())), bias=float(b), labels=[_plain(v) for v in labels])

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        state = self.state

        def run(texts: list) -> pa.Array:
            weights, bias = state["weights"], state["bias"]
            out = []
            for t in texts:
                known = [weights[w] for w in _TERM.findall((t or "").lower()) if w in weights]
                z = bias + (sum(known) / len(known) if known else 0.0)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            return pa.array(out, pa.float64())

        no, yes = state["labels"]
        return df.withColumn("score", by_slices(run, "double", F.col(text))).withColumn("prediction", F.when(F.col("score") >= 0.5, F.lit(yes)).otherwise(F.lit(no)))
