"""Classifiers, regressors and clustering on (features, label or target).

What is fitted by full-batch gradient descent runs on statistics of fixed size where the loss allows (linear regression), or on
the distinct weighted rows of a bounded, documented sample on the driver where it doesn't; scoring is always a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .base import Classifier, Clusterer, InvalidArgument, ProbabilisticClassifier, Regressor, check_matrix
from .features import _lits
from .neighbours import TOGETHER, packed, pairs
from .ordering import doubles, draw

SAMPLE = 200_000  # rows that classifiers fitted on the driver see at most


def driver_sample(df: DataFrame, columns: list[str], order: str, most: int = SAMPLE, seed: int = 42) -> pd.DataFrame:
    """All rows in ``order``, or a seeded sample of about ``most`` of them if there are more."""
    n = df.count()
    if n > most:
        df = df.where(draw(seed, order) < int(most / n * 2**32))
    rows = df.select(order, *columns).toPandas().sort_values(order, kind="stable")
    return rows.reset_index(drop=True)


def driver_samples(df: DataFrame, order: str, fold: str, most: int = SAMPLE, seed: int = 42) -> dict[Any, Sample]:
    """For each fold, and None, what ``driver_sample`` has of the features and labels of the rows of the other folds, or of all.

    The samples are of the same draws, so a row that several have is sent once, as Arrow; a row that none has stays where it is.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(fold).count().collect()}
    total, folds = sum(sizes.values()), [f for f in sizes if f is not None]
    known = total - sizes.get(None, 0)
    below = {f: min(2**32, int(most / max(1, n) * 2**32)) for f, n in [*((f, known - sizes[f]) for f in folds), (None, total)]}
    asked = F.lit(below[None])  # the draws of a fold below which some sample has them
    for f in folds:
        asked = F.when(F.col("fold") == F.lit(f), max(below[g] for g in below if g != f)).otherwise(asked)
    drawn = F.coalesce(draw(seed, order), F.lit(2**32 - 1))
    sent = df.select(F.col(order).alias("order"), F.col(fold).alias("fold"), F.col("features").cast("array<double>").alias("features"), "label", drawn.alias("draw")).where(F.col("draw") < asked).toArrow()
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in sent["features"].chunks)]).reshape(sent.num_rows, -1)
    rows = sent.drop(["features"]).to_pandas().reset_index(names="at").sort_values("order", kind="stable")
    out = {}
    for f, most_draw in below.items():
        own = rows[(rows["draw"] < most_draw) & (True if f is None else rows["fold"].notna() & (rows["fold"] != f))]
        out[f] = Sample(x, own["at"].to_numpy(), list(own["label"]))
    return out


@dataclass
class Sample:
    """Rows ``at`` of a matrix, and their labels."""

    all: np.ndarray
    at: np.ndarray
    labels: list

    @property
    def x(self) -> np.ndarray:
        return self.all[self.at]


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([list(x) for x in column], float).reshape(len(column), -1)


@dataclass
class KNearestNeighbors(Classifier):
    """Euclidean brute force; weight 1 / (d + 1e-12) or 1; ties go by votes, best distance, label. Needs ``order`` to break ties of neighbours.

    Both sides are packed into blocks, and every block of queries meets every block of training rows once in an Arrow pass. Matrix
    products in single precision, with a bound on their error, say which pairs may be among the k nearest; the distances of those are
    taken in double. Nothing is broadcast by hand, so either side may be large.
    """

    k: int = 3
    weighted: bool = True
    order: str = "row_id"
    block: int = 4096

    def fit(self, df: DataFrame):
        if self.k < 1:
            raise InvalidArgument("k must be positive")
        check_matrix(df)
        self.__dict__["_train"] = df.select(self.order, "features", "label")
        return self._trained(fitted=True)

    def neighbours(self, df: DataFrame, key: str, exclude_self: bool = False) -> DataFrame:
        """key, rank, order, label, distance."""
        self.state  # noqa: B018
        train, k = self.__dict__["_train"], self.k
        types = dict(train.dtypes)

        left = packed(df.select(F.col(key).alias("i"), F.col("features").cast("array<double>").alias("x")), self.block, 1)
        right = packed(train.select(F.col(self.order).alias("i"), F.col("features").cast("array<double>").alias("x"), F.col("label").alias("y")), self.block, TOGETHER, k + 1)
        near = pairs(left, right, k, exclude_self, f"i {dict(df.dtypes)[key]}, n {types[self.order]}, label {types['label']}, distance double")
        rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "n"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("i").alias(key), "rank", F.col("n").alias("neighbour"), "label", "distance")

    def predict(self, df: DataFrame, key: str = "row_id", exclude_self: bool = False) -> DataFrame:
        n = self.neighbours(df, key, exclude_self)
        vote = 1 / (F.col("distance") + 1e-12) if self.weighted else F.lit(1.0)
        votes = n.groupBy(key, "label").agg(F.sum(vote).alias("votes"), F.min("distance").alias("nearest"))
        best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "nearest", F.col("label").cast("string")))
        return votes.withColumn("_n", best).where("_n = 1").select(key, F.col("label").alias("prediction"))


@dataclass
class GaussianNaiveBayes(Classifier):
    """Sample variances with a floor; the label that appears first (by ``order``) wins ties."""

    var_smoothing: float = 1e-9
    order: str = "row_id"

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        cols = [F.col("features")[j].cast("double") for j in range(d)]
        rows = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(self.order).alias("o"), F.array(*[F.avg(c) for c in cols]).alias("m"), F.array(*[F.coalesce(F.var_samp(c), F.lit(0.0)) for c in cols]).alias("v")).orderBy("o").collect()
        total = sum(r.n for r in rows)
        return self._trained(labels=[r.label for r in rows], prior=[r.n / total for r in rows], mean=[list(r.m) for r in rows], var=[[max(x, self.var_smoothing) for x in r.v] for r in rows])

    def log_posteriors(self) -> list[Column]:
        s = self.state
        out = []
        for p, m, v in zip(s["prior"], s["mean"], s["var"]):
            terms = F.transform(F.arrays_zip(F.col("features"), _lits(m).alias("m"), _lits(v).alias("v")), lambda z: -0.5 * F.log(2 * math.pi * z["v"]) - (z["features"] - z["m"]) * (z["features"] - z["m"]) / (2 * z["v"]))
            out.append(F.aggregate(terms, F.lit(math.log(p)), lambda a, x: a + x))
        return out

    def _most(self, posts: Column) -> Column:
        labels = F.array(*[F.lit(x) for x in self.state["labels"]])
        at = F.array_position(posts, F.array_max(posts))
        return F.element_at(labels, at.cast("int"))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._most(F.array(*self.log_posteriors())))

    def predict_swapped(self, df: DataFrame, swaps: str) -> DataFrame:
        """Sums over all features are made once a row; a swap changes one term of each."""
        rows = df.withColumn("_posts", F.array(*self.log_posteriors())).withColumn("swap", F.explode(swaps)).drop(swaps)
        at, posts = F.col("swap.j") + 1, []
        old, new = F.element_at("features", at), F.col("swap.v")
        for k, (m, v) in enumerate(zip(self.state["mean"], self.state["var"])):
            mean, var = F.element_at(_lits(m), at), F.element_at(_lits(v), at)
            posts.append(F.col("_posts")[k] + ((old - mean) * (old - mean) - (new - mean) * (new - mean)) / (2 * var))
        return rows.withColumn("_posts", F.array(*posts)).withColumn("prediction", self._most(F.col("_posts"))).drop("_posts")


@dataclass
class LogisticRegression(ProbabilisticClassifier):
    """Full-batch gradient descent from zeros; the second label seen is positive. Equal rows are counted, so few distinct rows cost little.

    Fitted on the driver to at most ``sample`` rows (seeded, if there are more).
    """

    learning_rate: float = 0.1
    iterations: int = 1000
    l2: float = 0.0
    order: str = "row_id"
    sample: int = SAMPLE

    def fit(self, df: DataFrame):
        check_matrix(df)
        rows = driver_sample(df, ["features", "label"], self.order, self.sample)
        return self.fit_rows(matrix(rows["features"]), list(rows["label"]))

    def fit_rows(self, x: np.ndarray, y: list):
        labels = list(dict.fromkeys(y))
        if len(labels) != 2:
            raise InvalidArgument("needs two labels")
        t = np.array([float(v == labels[1]) for v in y])
        w, b, n = np.zeros(x.shape[1]), 0.0, len(t)
        for _ in range(self.iterations):
            z = x @ w + b
            e = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z)))) - t
            w, b = w - self.learning_rate * (x.T @ e / n + self.l2 * w), b - self.learning_rate * e.mean()
        return self._trained(weights=w.tolist(), bias=float(b), labels=[_plain(v) for v in labels])

    partial_fit = fit  # a full retraining

    def score(self) -> Column:
        return V.sigmoid(V.dot("features", _lits(self.state["weights"])) + self.state["bias"])

    def predict(self, df: DataFrame) -> DataFrame:
        no, yes = self.state["labels"]
        return df.withColumn("score", self.score()).withColumn("prediction", F.when(F.col("score") >= 0.5, F.lit(yes)).otherwise(F.lit(no)))


def _plain(v: Any) -> Any:
    return v.item() if hasattr(v, "item") else v


@dataclass
class LinearRegression(Regressor):
    """Full-batch gradient descent from zeros, run on the Gram matrix of one pass: the same steps, whatever the number of rows."""

    learning_rate: float = 0.01
    iterations: int = 2000
    l2: float = 0.0

    def fit(self, df: DataFrame):
        return self.fit_to(self.statistics(df)[None])

    @staticmethod
    def statistics(df: DataFrame, fold: str | None = None) -> dict[Any, np.ndarray]:
        """The Gram matrix of (features, 1, target) of each fold, or of all rows under None: one pass, each task adds up one table."""
        d = check_matrix(df)
        kind = dict(df.dtypes)[fold] if fold else "int"

        def part(batches):
            sums: dict[Any, np.ndarray] = {}
            for b in batches:
                for f, rows in b.groupby("fold", dropna=False) if fold else [(None, b)]:
                    if len(rows):
                        m = np.column_stack([np.concatenate(rows["features"].to_numpy()).reshape(-1, d).astype(float), np.ones(len(rows)), rows["target"].to_numpy(float)])
                        sums[f] = sums.get(f, 0) + m.T @ m
            yield pd.DataFrame({"fold": pd.Series(list(sums), dtype=object), "g": pd.Series([g.ravel() for g in sums.values()], dtype=object)})

        rows = df.select((F.col(fold) if fold else F.lit(None).cast("int")).alias("fold"), F.col("features").cast("array<double>").alias("features"), F.col("target").cast("double").alias("target"))
        parts = rows.mapInPandas(part, f"fold {kind}, g array<double>")
        # added up by a few tasks: a row a fold reaches the driver, in one job
        cells = parts.select("fold", F.posexplode("g").alias("at", "x")).groupBy("fold", "at").agg(F.sum("x").alias("x")).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("g"))
        return {r.fold: np.array([c.x for c in r.g]).reshape(d + 2, d + 2) for r in cells.collect()}

    def fit_to(self, g: np.ndarray):
        d = len(g) - 2
        n = g[d, d]
        gram, right = g[: d + 1, : d + 1] / n, g[: d + 1, d + 1] / n
        theta, decay = np.zeros(d + 1), np.append(np.full(d, self.l2), 0.0)
        for _ in range(self.iterations):
            theta = theta - self.learning_rate * (gram @ theta - right + decay * theta)
        return self._trained(weights=theta[:d].tolist(), bias=float(theta[d]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", V.dot("features", _lits(self.state["weights"])) + self.state["bias"])


BINS = 256
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A draw in [0, 1) for each 64-bit key."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def stump_sums(df: DataFrame, order: str, channels, width: int, columns: list[str], picks: np.ndarray, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The cuts of each feature, and for each tree and picked feature the sums of the channels in each of its bins, over all rows.

    Trees see each row as often as a Poisson draw of mean 1 says, by the row's key. Cuts are observed values at quantiles, all of
    them where there are few; bin b holds what lies above cut b - 1 and not above cut b. One pass adds up a table of fixed size in
    each partition, a few tasks add those up, and their sums reach the driver.
    """
    used = sorted(set(picks.ravel().tolist()))
    steps = doubles(i / BINS for i in range(1, BINS))
    row = df.agg(*[F.percentile_approx(F.col("features")[j].cast("double"), steps, 10_000) for j in used]).first()
    cuts = {j: np.unique(np.array(c, float)) for j, c in zip(used, row)}
    trees, m = picks.shape
    shape = (trees, m, BINS + 1, width)

    def part(batches):
        total = None
        for b in batches:
            if not len(b):
                continue
            total = np.zeros(shape) if total is None else total
            x, key, values = matrix(b["features"]), b["_key"].to_numpy(np.int64), channels(b)
            bins = {j: np.searchsorted(cuts[j], x[:, j], "left") for j in used}
            for t in range(trees):
                times = np.searchsorted(_POISSON, _uniform(key, seed * 100_003 + t), "right")
                for i, j in enumerate(picks[t]):
                    for c in range(width):
                        total[t, i, :, c] += np.bincount(bins[j], times * values[:, c], BINS + 1)
        yield pd.DataFrame({"g": [] if total is None else [total.tobytes()]})

    def add(batches):
        total = None
        for b in batches:
            for g in b["g"]:
                total = np.frombuffer(g) + (0 if total is None else total)
        yield pd.DataFrame({"g": [] if total is None else [total.tobytes()]})

    rows = df.select(F.xxhash64(order).alias("_key"), F.col("features").cast("array<double>").alias("features"), *columns)
    total = np.zeros(shape)
    for r in rows.mapInPandas(part, "g binary").repartition(8).mapInPandas(add, "g binary").toLocalIterator():
        total += np.frombuffer(r.g).reshape(shape)
    return [cuts.get(j, np.zeros(0)) for j in range(max(used) + 1)], total


def _best(cuts: list[np.ndarray], picks: np.ndarray, sums: np.ndarray, cost) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(feature, threshold, sums on the left, on the right) of least cost; feature -1 where nothing divides the rows."""
    best = (math.inf, -1, math.inf, sums[0].sum(0), np.zeros(sums.shape[2]))
    for i, j in enumerate(picks):
        left = sums[i].cumsum(0)[: len(cuts[j])]
        right = sums[i].sum(0) - left
        c = cost(left, right)
        if len(c) and np.nanmin(c) < best[0]:
            k = int(np.nanargmin(c))
            best = (float(c[k]), int(j), float(cuts[j][k]), left[k], right[k])
    return best[1:]


@dataclass
class RandomForestClassifier(Classifier):
    """Bootstrapped stumps of least Gini impurity on a random choice of features; the majority of their votes. Fitted to all rows."""

    n_trees: int = 50
    max_features: int | None = None
    seed: int = 42
    order: str = "row_id"

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        labels = [r.label for r in df.groupBy("label").agg(F.min(self.order).alias("o")).orderBy("o").collect()]
        r = np.random.default_rng(self.seed)
        m = min(d, self.max_features or max(1, math.isqrt(d)))
        picks = np.array([r.choice(d, m, replace=False) for _ in range(self.n_trees)])
        channels = lambda b: np.column_stack([(b["label"] == v).to_numpy(float) for v in labels])
        cuts, sums = stump_sums(df, self.order, channels, len(labels), ["label"], picks, self.seed)

        def gini(left, right):
            a, b = left.sum(1), right.sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                c = (a - (left**2).sum(1) / a + b - (right**2).sum(1) / b) / (a + b)
            return np.where((a > 0) & (b > 0), c, np.inf)

        stumps = []
        for t in range(self.n_trees):
            j, cut, left, right = _best(cuts, picks[t], sums[t], gini)
            stumps.append([max(j, 0), cut, int(np.argmax(left)), int(np.argmax(right if j >= 0 else left))])
        return self._trained(stumps=stumps, labels=[_plain(v) for v in labels])

    def predict(self, df: DataFrame) -> DataFrame:
        labels = self.state["labels"]
        says = [F.when(F.col("features")[j] <= t, a).otherwise(b) for j, t, a, b in self.state["stumps"]]
        votes = F.array(*says)
        counts = F.array(*[F.size(F.filter(votes, _is(i))) for i in range(len(labels))])
        return df.withColumn("prediction", F.element_at(F.array(*map(F.lit, labels)), F.array_position(counts, F.array_max(counts)).cast("int")))


def _is(i: int):
    return lambda v: v == i


@dataclass
class RandomForestRegressor(Regressor):
    """Bootstrapped stumps of least squared error; the mean of their leaves. Fitted to all rows."""

    n_trees: int = 50
    max_features: int | None = None
    seed: int = 42
    order: str = "row_id"

    def fit(self, df: DataFrame):
        d = check_matrix(df)
        r = np.random.default_rng(self.seed)
        m = min(d, self.max_features or max(1, d // 3))
        picks = np.array([r.choice(d, m, replace=False) for _ in range(self.n_trees)])
        middle = float(df.agg(F.avg("target")).first()[0])  # sums of squares about it lose nothing

        def channels(b):
            y = b["target"].to_numpy(float) - middle
            return np.column_stack([np.ones(len(y)), y, y * y])

        cuts, sums = stump_sums(df, self.order, channels, 3, ["target"], picks, self.seed)

        def error(left, right):
            with np.errstate(invalid="ignore", divide="ignore"):
                c = left[:, 2] - left[:, 1] ** 2 / left[:, 0] + right[:, 2] - right[:, 1] ** 2 / right[:, 0]
            return np.where((left[:, 0] > 0) & (right[:, 0] > 0), c, np.inf)

        stumps = []
        for t in range(self.n_trees):
            j, cut, left, right = _best(cuts, picks[t], sums[t], error)
            mean = [middle + float(s[1] / s[0]) if s[0] else middle for s in (left, right)]
            stumps.append([max(j, 0), cut, *(mean if j >= 0 else mean[:1] * 2)])
        return self._trained(stumps=stumps)

    def predict(self, df: DataFrame) -> DataFrame:
        leaves = [F.when(F.col("features")[j] <= t, a).otherwise(b) for j, t, a, b in self.state["stumps"]]
        return df.withColumn("prediction", F.aggregate(F.array(*leaves), F.lit(0.0), lambda s, x: s + x) / len(leaves))


@dataclass
class MLPBinaryClassifier(ProbabilisticClassifier):
    """One ReLU layer and a sigmoid, row-by-row gradient descent in order; the hidden gradient uses the updated output weights. On at most ``sample`` rows."""

    hidden: int = 8
    epochs: int = 500
    learning_rate: float = 0.05
    seed: int = 42
    order: str = "row_id"
    sample: int = 20_000

    def fit(self, df: DataFrame):
        check_matrix(df)
        rows = driver_sample(df, ["features", "label"], self.order, self.sample)
        return self.fit_rows(matrix(rows["features"]), list(rows["label"]))

    def fit_rows(self, x: np.ndarray, y: list):
        d, labels = x.shape[1], sorted(set(y))
        if len(labels) != 2:
            raise InvalidArgument("needs two labels")
        y = np.array([float(v == labels[1]) for v in y])
        r = np.random.default_rng(self.seed)
        w1, b1 = r.uniform(-0.5, 0.5, (self.hidden, d)), np.zeros(self.hidden)
        w2, b2 = r.uniform(-0.5, 0.5, self.hidden), 0.0
        for _ in range(self.epochs):
            for xi, yi in zip(x, y):
                z = w1 @ xi + b1
                h = np.maximum(z, 0)
                e = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(w2 @ h + b2))))) - yi
                w2 = w2 - self.learning_rate * e * h
                b2 -= self.learning_rate * e
                g = self.learning_rate * e * w2 * (z > 0)
                w1, b1 = w1 - np.outer(g, xi), b1 - g
        return self._trained(w1=w1.tolist(), b1=b1.tolist(), w2=w2.tolist(), b2=float(b2), labels=[_plain(v) for v in labels])

    def predict(self, df: DataFrame) -> DataFrame:
        s = self.state
        z = F.lit(s["b2"])
        for w, b, out in zip(s["w1"], s["b1"], s["w2"]):
            z = z + out * F.greatest(F.lit(0.0), V.dot("features", _lits(w)) + b)
        no, yes = s["labels"]
        return df.withColumn("score", V.sigmoid(z)).withColumn("prediction", F.when(F.col("score") >= 0.5, F.lit(yes)).otherwise(F.lit(no)))


@dataclass
class MiniBatchKMeans(Clusterer):
    """Centroids start at the first k rows of a shuffle of all rows and move by 1 / count towards the members of batches.

    Batches are the next rows of the shuffle; where there are too few rows, draws of all of them. The method needs no more than
    k + iterations x batch rows, which are what reaches the driver.
    """

    k: int = 8
    iterations: int = 100
    batch: int = 32
    seed: int = 42
    order: str = "row_id"

    def fit(self, df: DataFrame):
        check_matrix(df)
        need = self.k + self.iterations * self.batch
        shuffled = df.select(self.order, "features", draw(self.seed, self.order).alias("_draw")).orderBy("_draw", self.order).limit(need)
        x = matrix(shuffled.select("features").toPandas()["features"])
        r = np.random.default_rng(self.seed)
        c = x[: self.k].copy()
        rest = x[self.k :] if len(x) == need else x[r.integers(0, len(x), self.iterations * min(self.batch, len(x)))]
        count = np.zeros(len(c))
        for members in np.array_split(rest, self.iterations):
            for row in members:
                i = int(((c - row) ** 2).sum(1).argmin())
                count[i] += 1
                c[i] += (row - c[i]) / count[i]
        return self._trained(centroids=c.tolist())

    def predict(self, df: DataFrame) -> DataFrame:
        d = F.array(*[V.euclidean("features", _lits(c)) for c in self.state["centroids"]])
        return df.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))
