"""Metrics as aggregate columns; the two areas under curves, which need an order, as operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _counts(y, p, positive) -> tuple[Column, Column, Column, Column]:
    t, s = _col(y) == F.lit(positive), _col(p) == F.lit(positive)
    return tuple(F.count_if(a & b).cast("double") for a, b in ((t, s), (~t, s), (t, ~s), (~t, ~s)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def accuracy(y, p) -> Column:
    return F.avg((_col(y) == _col(p)).cast("double"))


def precision(y, p, positive) -> Column:
    tp, fp, _, _ = _counts(y, p, positive)
    return _ratio(tp, tp + fp)


def recall(y, p, positive) -> Column:
    tp, _, fn, _ = _counts(y, p, positive)
    return _ratio(tp, tp + fn)


def f1(y, p, positive) -> Column:
    tp, fp, fn, _ = _counts(y, p, positive)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def matthews(y, p, positive) -> Column:
    tp, fp, fn, tn = _counts(y, p, positive)
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def log_loss(y, score, positive, eps: float = 1e-15) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _col(score).cast("double")))
    return F.avg(-F.log(F.when(_col(y) == F.lit(positive), p).otherwise(1 - p)))


def brier(y, score, positive) -> Column:
    return F.avg(F.pow(_col(score) - (_col(y) == F.lit(positive)).cast("double"), F.lit(2)))


def roc_auc(df: DataFrame, y: str, score: str, positive, ties: list[str]) -> DataFrame:
    """One row, ``roc_auc``: each negative row adds the share of positives before it. Tied scores count in the order ``ties``; 0 if one class is missing."""
    pos = (F.col(y) == F.lit(positive)).cast("long")
    d = ranked(df.withColumn("_pos", pos), F.col(score), ties, descending=True, sums={"_tp": F.col("_pos")})
    a = d.agg(F.sum(F.when(F.col("_pos") == 0, F.col("_tp"))).cast("double").alias("area"), F.sum("_pos").alias("p"), F.sum(1 - F.col("_pos")).alias("n"))
    return a.select(F.coalesce(F.col("area") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), F.lit(0.0)).alias("roc_auc"))


def pr_auc(df: DataFrame, y: str, score: str, positive, ties: list[str]) -> DataFrame:
    """One row, ``pr_auc``: trapezoids between successive precisions at each positive row, the first from precision 1."""
    pos = (F.col(y) == F.lit(positive)).cast("long")
    d = ranked(df.withColumn("_pos", pos), F.col(score), ties, descending=True, sums={"_tp": F.col("_pos")})
    before = F.when(F.col("rn") == 1, 1.0).otherwise((F.col("_tp") - 1) / F.nullif(F.col("rn") - 1, F.lit(0)))
    a = d.where("_pos = 1").agg(F.sum((F.col("_tp") / F.col("rn") + before) / 2).alias("area"), F.count(F.lit(1)).alias("p"))
    return a.select(F.coalesce(F.col("area") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)).alias("pr_auc"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, precision, recall, f1, support for each label of either column."""
    both = df.select(F.explode(F.array_distinct(F.array(F.col(y), F.col(p)))).alias("label"), F.col(y).alias("y"), F.col(p).alias("p"))
    hit = (F.col("y") == F.col("label")) & (F.col("p") == F.col("label"))
    c = both.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("y") == F.col("label")).alias("support"), F.count_if(F.col("p") == F.col("label")).alias("said"))
    return c.select("label", _ratio(F.col("tp").cast("double"), F.col("said").cast("double")).alias("precision"), _ratio(F.col("tp").cast("double"), F.col("support").cast("double")).alias("recall"), _ratio(2.0 * F.col("tp"), (F.col("said") + F.col("support")).cast("double")).alias("f1"), "support")


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """actual, predicted, n: dense over the union of labels, 0 where a pair doesn't occur."""
    pairs = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(pairs, ["actual", "predicted"], "left").na.fill(0, ["n"])


def mse(y, p) -> Column:
    return F.avg(F.pow(_col(y) - _col(p), F.lit(2)))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(_col(y) - _col(p)))


def r2(y, p) -> Column:
    """0 where all targets are equal."""
    total = F.var_pop(_col(y))
    return F.when(total == 0, 0.0).otherwise(1 - mse(y, p) / F.nullif(total, F.lit(0.0)))


def mape(y, p) -> Column:
    return F.avg(F.abs(_col(y) - _col(p)) / F.greatest(F.abs(_col(y)), F.lit(1e-12)))
