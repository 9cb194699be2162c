"""Train/test splits, folds and resampling as columns of the table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import draw, ranked


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``is_test``; exactly max(1, floor(n test_size)) rows, the last in a seeded order of ``key``, are test rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    n = df.count()
    cut = n - max(1, math.floor(n * test_size))
    return ranked(df, draw(seed, key), [key], uniform=True).withColumn("is_test", F.col("rn") > cut).drop("rn")


def k_fold(df: DataFrame, key: str, k: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """df with ``fold`` (from 0): contiguous blocks of the (seeded) order, the first n mod k of them one longer."""
    n = df.count()
    if not 2 <= k <= max(n, 2):
        raise ValueError("k must be between 2 and the number of rows")
    base, more = divmod(n, k)
    at = F.col("rn") - 1
    fold = F.when(at < more * (base + 1), F.floor(at / (base + 1))).otherwise(more + F.floor((at - more * (base + 1)) / max(base, 1)))
    return ranked(df, draw(seed, key) if shuffle else F.col(key), [key], uniform=shuffle).withColumn("fold", fold.cast("int")).drop("rn")


def stratified_k_fold(df: DataFrame, key: str, label: str, k: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """df with ``fold``: round robin inside each label, in the (seeded) order."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    d = ranked(df, draw(seed, key) if shuffle else F.col(key), [key], within=[label], uniform=shuffle)
    return d.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def time_series_split(df: DataFrame, by: str, ties: list[str], k: int = 5, test_size: int | None = None) -> DataFrame:
    """A row for each row and split that uses it: ``split`` and ``role``; split i trains on the first (i+1)t rows and tests on the next t."""
    n = df.count()
    t = test_size or max(1, n // (k + 1))
    if k < 1 or t < 1:
        raise ValueError("k and test_size must be positive")
    d = ranked(df, F.col(by).cast("timestamp").cast("double") if dict(df.dtypes)[by].startswith("timestamp") else F.col(by), ties)
    used = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("rn") <= (i + 2) * t) & ((i + 1) * t < F.lit(n)))
    d = d.withColumn("split", F.explode(used))
    return d.withColumn("role", F.when(F.col("rn") <= (F.col("split") + 1) * t, "train").otherwise("test")).drop("rn")


#: cumulative Poisson(1) probabilities, on 2**32
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) * 2**32) for i in range(9)]


def bootstrap_weights(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with ``times``, how often a row is in a bootstrap sample: a Poisson(1) draw, the limit of n draws with replacement."""
    u = draw(seed, key)
    times = F.lit(len(POISSON))
    for i in reversed(range(len(POISSON))):
        times = F.when(u < POISSON[i], i).otherwise(times)
    return df.withColumn("times", times)


def stride_sample(df: DataFrame, by: str, ties: list[str], limit: int, within: list[str] | None = None) -> DataFrame:
    """Every ceil(n / limit)-th row in order, at most ``limit`` (of each group)."""
    if limit < 1:
        raise ValueError("limit must be positive")
    d = ranked(df, F.col(by), ties, within=within)
    if within:
        n = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
        d = d.join(n, within)
    else:
        d = d.withColumn("_n", F.lit(df.count()))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / limit))
    return d.where((F.col("rn") - 1) % step == 0).select(*df.columns)
