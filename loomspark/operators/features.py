"""Feature transforms: fitting is one aggregate, transforming one projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import InvalidArgument, Transformer, check_matrix


def _lits(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _columns(d: int, column: str = "features") -> list[Column]:
    return [F.col(column)[j].cast("double") for j in range(d)]


@dataclass
class StandardScaler(Transformer):
    """(x - mean) / sample standard deviation; a constant column is only centred."""

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        row = df.agg(*[f(c) for c in _columns(d) for f in (F.avg, F.stddev_samp)]).first()
        return self._trained(mean=list(row[::2]), std=[x if x else 1.0 for x in row[1::2]])

    def transform(self, df: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("features"), _lits(self.state["mean"]).alias("m"), _lits(self.state["std"]).alias("s"))
        return df.withColumn("features", F.transform(pairs, lambda x: (x["features"] - x["m"]) / x["s"]))


@dataclass
class MinMaxScaler(Transformer):
    """(x - min) / (max - min); a constant column gives 0."""

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        row = df.agg(*[f(c) for c in _columns(d) for f in (F.min, F.max)]).first()
        return self._trained(low=list(row[::2]), range=[b - a for a, b in zip(row[::2], row[1::2])])

    def transform(self, df: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("features"), _lits(self.state["low"]).alias("m"), _lits(self.state["range"]).alias("s"))
        return df.withColumn("features", F.transform(pairs, lambda x: F.when(x["s"] == 0, 0.0).otherwise((x["features"] - x["m"]) / F.nullif(x["s"], F.lit(0.0)))))


@dataclass
class SimpleImputer(Transformer):
    """NaN (and null) becomes the column's mean or exact median; a column without numbers gives 0."""

    strategy: str = "mean"

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        f = F.median if self.strategy == "median" else F.avg
        row = df.agg(*[f(F.nullif(c, F.lit(float("nan")))) for c in _columns(d)]).first()
        return self._trained(fill=[0.0 if x is None else x for x in row])

    def transform(self, df: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("features"), _lits(self.state["fill"]).alias("m"))
        return df.withColumn("features", F.transform(pairs, lambda x: F.coalesce(F.nanvl(x["features"], x["m"]), x["m"])))


@dataclass
class OneHotEncoder(Transformer):
    """features is an array of strings; categories of each come in order of first appearance by ``order``; unknown ones give zeros."""

    order: str = "row_id"

    def fit(self, df: DataFrame):
        check_matrix(df)
        seen = df.select(F.col(self.order).alias("o"), F.posexplode("features").alias("j", "c")).groupBy("j", "c").agg(F.min("o").alias("o"))
        categories: list[list] = []
        for r in seen.orderBy("j", "o", "c").collect():
            while len(categories) <= r.j:
                categories.append([])
            categories[r.j].append(r.c)
        return self._trained(categories=categories)

    def transform(self, df: DataFrame) -> DataFrame:
        cells = [(F.col("features")[j].eqNullSafe(F.lit(c))).cast("double") for j, cs in enumerate(self.state["categories"]) for c in cs]
        return df.withColumn("features", F.array(*cells))


@dataclass
class PolynomialFeatures(Transformer):
    """x, then x_i x_j for i <= j; no bias. Degrees above 2 act like 2, degree 1 changes nothing."""

    degree: int = 2

    def fit(self, df: DataFrame):
        return self._trained(width=check_matrix(df))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.degree < 2:
            return df
        x = F.col("features")
        products = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda b: a * b)))
        return df.withColumn("features", F.concat(x, products))


def covariance(df: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample covariance from one Arrow pass that sends a d x d matrix a partition."""
    import pandas as pd

    def part(batches):
        n, total, gram = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if len(b):
                x = np.vstack(b["features"].to_numpy()).astype(float)
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        yield pd.DataFrame({"n": [n], "t": [total], "g": [gram.ravel()]})

    rows = df.select(F.col("features").cast("array<double>").alias("features")).mapInPandas(part, "n long, t array<double>, g array<double>").toLocalIterator()
    n, total, gram = 0, np.zeros(d), np.zeros((d, d))
    for r in rows:
        n, total, gram = n + r.n, total + np.array(r.t), gram + np.array(r.g).reshape(d, d)
    mean = total / max(n, 1)
    return n, mean, (gram - n * np.outer(mean, mean)) / max(1, n - 1)


@dataclass
class PCA(Transformer):
    """Leading eigenvectors of the sample covariance by power iteration from the uniform vector, each orthogonal to those before."""

    n_components: int = 2
    power_iterations: int = 50

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        _, mean, cov = covariance(df, d)
        found: list[np.ndarray] = []
        for _ in range(min(self.n_components, d)):
            v = np.full(d, 1 / np.sqrt(d))
            for _ in range(self.power_iterations):
                w = cov @ v
                for u in found:
                    w = w - (w @ u) * u
                size = np.linalg.norm(w)
                if size <= 1e-12:
                    v = w
                    break
                v = w / size
            found.append(v)
        return self._trained(mean=mean.tolist(), components=[v.tolist() for v in found])

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.zip_with("features", _lits(self.state["mean"]), lambda a, m: a - m)
        parts = [F.aggregate(F.zip_with(x, _lits(v), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for v in self.state["components"]]
        return df.withColumn("features", F.array(*parts))


@dataclass
class Pipeline(Transformer):
    """Transformers in order, then an optional classifier or regressor."""

    steps: list
    final: object = None

    def fit(self, df: DataFrame):
        for step in self.steps:
            df = step.fit(df).transform(df)
        if self.final is not None:
            self.final.fit(df)
        return self._trained(fitted=True)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        if self.final is None:
            raise InvalidArgument("the pipeline has no estimator")
        return self.final.predict(self.transform(df))
