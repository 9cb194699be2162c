"""Cross-validation, grid search, calibration, thresholds and permutation importance."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .base import Classifier, ProbabilisticClassifier, check_matrix
from .models import driver_samples
from .ordering import draw, ranked
from .splits import k_fold, stratified_k_fold

_CLASS = {
    "accuracy": lambda pos: M.accuracy("label", "prediction"),
    "f1": lambda pos: M.f1("label", "prediction", pos),
    "mcc": lambda pos: M.matthews("label", "prediction", pos),
    "neg_log_loss": lambda pos: -M.log_loss("label", "score", pos),
    "neg_brier": lambda pos: -M.brier("label", "score", pos),
}


def _regression(scoring: str) -> Column:
    f = {"r2": M.r2, "neg_rmse": M.rmse, "neg_mae": M.mae, "neg_mape": M.mape}[scoring]
    c = f("target", "prediction")
    return c if scoring == "r2" else -c


def out_of_fold(make: Callable[[], object], df: DataFrame, fold: str = "fold", sums: dict | None = None, samples: dict | None = None) -> DataFrame:
    """Each row predicted by a model that was fitted to the other folds; ``df`` has the fold column.

    A model that is fitted to ``statistics`` that add up takes those of the other folds from one pass (``sums``, if already made). One that is
    fitted on the driver takes its rows from one sending of them (``samples``, likewise).
    """
    model = make()
    if hasattr(model, "fit_to"):
        sums = sums or model.statistics(df, fold)
        folds = sorted(k for k in sums if k is not None)
        fitted = {k: lambda k=k: make().fit_to(sum(g for f, g in sums.items() if f is not None and f != k)) for k in folds}
    elif hasattr(model, "fit_rows"):
        samples = samples or sent_once(model, df, fold)
        folds = sorted(k for k in samples if k is not None)
        fitted = {k: lambda k=k: make().fit_rows(samples[k].x, samples[k].labels) for k in folds}
    else:
        folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
        fitted = {k: lambda k=k: make().fit(df.where(F.col(fold) != k)) for k in folds}
    out = None
    for k in folds:
        part = fitted[k]().predict(df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def sent_once(model, df: DataFrame, fold: str = "fold") -> dict:
    """What a model that is fitted on the driver needs of each fold, and of all rows under None."""
    check_matrix(df)
    return driver_samples(df, model.order, fold, model.sample)


def cross_val_score(make: Callable[[], object], df: DataFrame, scoring: str, order: str = "row_id", fold: str = "fold", sums: dict | None = None) -> DataFrame:
    """fold, score. The positive class is the label of the first row by ``order``."""
    p = out_of_fold(make, df, fold, sums)
    if scoring in ("roc_auc", "pr_auc"):
        pos = df.orderBy(order).select("label").first()[0]
        f = M.roc_auc if scoring == "roc_auc" else M.pr_auc
        parts = None
        for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
            one = f(p.where(F.col(fold) == k), "label", "score", pos, [order]).select(F.lit(k).alias(fold), F.col(scoring).alias("score"))
            parts = one if parts is None else parts.unionByName(one)
        return parts
    if scoring in _CLASS:
        pos = df.orderBy(order).select("label").first()[0]
        return p.groupBy(fold).agg(_CLASS[scoring](pos).alias("score"))
    return p.groupBy(fold).agg(_regression(scoring).alias("score"))


def grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def grid_search(make: Callable[..., object], df: DataFrame, space: dict[str, list], scoring: str, cv: int = 3, order: str = "row_id"):
    """(best parameters, their mean score, the model refitted to all rows); the first of equals. Folds are seeded."""
    folded = k_fold(df, order, cv).persist()
    try:
        best: tuple[float, dict] | None = None
        first = make(**grid(space)[0])
        sums = first.statistics(folded, "fold") if hasattr(first, "fit_to") else None  # the same for all points of the grid
        for params in grid(space):
            score = cross_val_score(lambda p=params: make(**p), folded, scoring, order, sums=sums).agg(F.avg("score")).first()[0]
            if best is None or score > best[0]:
                best = (score, params)
    finally:
        folded.unpersist()
    model = make(**best[1])
    return best[1], best[0], model.fit_to(sum(sums.values())) if sums else model.fit(df)


@dataclass
class CalibratedClassifierCV(ProbabilisticClassifier):
    """Platt's two parameters from out-of-fold scores, by gradient descent; the base model is then fitted to all rows."""

    base: Classifier = None
    cv: int = 5
    iterations: int = 300
    learning_rate: float = 0.1
    order: str = "row_id"

    def fit(self, df: DataFrame):
        folded = stratified_k_fold(df, self.order, "label", self.cv)
        fresh = lambda: self.base.with_params()
        samples = sent_once(self.base, folded) if hasattr(self.base, "fit_rows") else None
        oof = out_of_fold(fresh, folded, samples=samples)
        labels = [r[0] for r in df.groupBy("label").agg(F.min(self.order).alias("o")).orderBy("o").collect()]
        yes = labels[-1]
        # a histogram of scores stands for them: fixed in size, exact to 1e-4
        h = oof.groupBy(F.round("score", 4).alias("s"), (F.col("label") == F.lit(yes)).alias("y")).count().collect()
        s, y, n = np.array([r.s for r in h]), np.array([float(r.y) for r in h]), np.array([float(r["count"]) for r in h])
        a, b = 1.0, 0.0
        for _ in range(self.iterations):
            e = (1 / (1 + np.exp(-(a * s + b))) - y) * n / n.sum()
            a, b = a - self.learning_rate * float(e @ s), b - self.learning_rate * float(e.sum())
        self.__dict__["_model"] = fresh().fit_rows(samples[None].x, samples[None].labels) if samples else fresh().fit(df)
        return self._trained(a=a, b=b, labels=labels, model=self.__dict__["_model"].to_dict())

    def predict(self, df: DataFrame) -> DataFrame:
        from ..functions.vectors import sigmoid
        from .base import Parametric

        s = self.state
        model = self.__dict__.get("_model") or Parametric.from_dict(s["model"])
        d = model.predict(df).withColumn("score", sigmoid(s["a"] * F.col("score") + s["b"]))
        return d.withColumn("prediction", F.when(F.col("score") >= 0.5, F.lit(s["labels"][-1])).otherwise(F.lit(s["labels"][0])))


def tune_threshold(df: DataFrame, label: str, score: str, positive, metric: str = "f1", steps: int = 101) -> DataFrame:
    """One row, threshold and value: the best of ``steps`` thresholds in [0, 1], the lowest of equals.

    A histogram over the thresholds and running sums give all values from one aggregate of fixed size.
    """
    if steps < 2:
        raise ValueError("steps must be 2 at least")
    at = F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])
    bin_ = F.size(F.filter(at, lambda t: t <= F.col("_s")))  # passes the first so many thresholds
    h = df.select(F.col(score).alias("_s"), (F.col(label) == F.lit(positive)).cast("long").alias("_y")).select(bin_.alias("bin"), "_y").groupBy("bin").agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n"))
    t = df.sparkSession.range(steps).select((F.col("id") / (steps - 1)).alias("threshold"), F.col("id"))
    c = t.crossJoin(F.broadcast(h)).groupBy("threshold", "id").agg(  # both of at most steps + 1 rows
        F.sum(F.when(F.col("bin") > F.col("id"), F.col("p")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(F.col("bin") > F.col("id"), F.col("n") - F.col("p")).otherwise(0)).cast("double").alias("fp"),
        F.sum("p").cast("double").alias("p"),
        F.sum("n").cast("double").alias("n"),
    )
    fn, tn = F.col("p") - F.col("tp"), F.col("n") - F.col("p") - F.col("fp")
    tp, fp = F.col("tp"), F.col("fp")
    value = {
        "f1": M._ratio(2 * tp, 2 * tp + fp + fn),
        "precision": M._ratio(tp, tp + fp),
        "recall": M._ratio(tp, tp + fn),
        "accuracy": (tp + tn) / F.col("n"),
        "mcc": M._ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }[metric]
    return c.select("threshold", value.alias("value")).orderBy(F.desc("value"), "threshold").limit(1)


def apply_threshold(score: Column | str, threshold: float, positive, negative) -> Column:
    return F.when((F.col(score) if isinstance(score, str) else score) >= threshold, F.lit(positive)).otherwise(F.lit(negative))


def permutation_importance(model: Classifier, df: DataFrame, repeats: int = 3, seed: int = 42, order: str = "row_id") -> DataFrame:
    """feature, importance: how much accuracy falls when one feature's values are permuted among rows, on average over repeats.

    One pass for all features and repeats: values are numbered by seeded draw within each, gathered by number, and the row of that
    number is predicted once for each.
    """
    d = df.select(F.size("features")).first()[0]
    base = model.predict(df).agg(M.accuracy("label", "prediction")).first()[0]
    runs = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(r).alias("r")) for j in range(d) for r in range(repeats)])
    values = df.select(order, "features", F.explode(runs).alias("_run")).select(order, "_run.j", "_run.r", F.element_at("features", F.col("_run.j") + 1).alias("v"))
    values = values.withColumn("_draw", draw(F.concat_ws("-", F.lit(str(seed)), F.col("j"), F.col("r")), order))
    swaps = ranked(values, F.col("_draw"), [order], within=["j", "r"], uniform=True).groupBy("rn").agg(F.collect_list(F.struct("j", "r", "v")).alias("_swaps"))
    rows = model.predict_swapped(ranked(df, F.col(order), [order]).join(swaps, "rn"), "_swaps")
    drops = rows.groupBy(F.col("swap.j").alias("j"), F.col("swap.r").alias("r")).agg(M.accuracy("label", "prediction").alias("a"))
    return drops.groupBy(F.col("j").alias("feature")).agg((F.sum(F.lit(base) - F.col("a")) / repeats).alias("importance"))
