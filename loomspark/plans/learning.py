"""Queries: models, folds, calibration and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import models as L
from ..operators import selection as S
from ..operators.sentiment import SentimentAnalyzer
from ..operators.ordering import draw_sql
from ..operators.splits import k_fold
from .tabular import _SCORED, _scored, r6, read


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def knn_predict(spark, sf):
    """Each vector by its three nearest others."""
    v = _vectors(spark, sf)
    return L.KNearestNeighbors(3).fit(v).predict(v, exclude_self=True)


def knn_neighbours(spark, sf):
    v = _vectors(spark, sf)
    return L.KNearestNeighbors(3).fit(v).neighbours(v, "row_id", exclude_self=True).select("row_id", "rank", "neighbour", "label", r6("distance").alias("distance"))


def gnb_fit(spark, sf):
    m = L.GaussianNaiveBayes().fit(_vectors(spark, sf)).state
    rows = [(lab, j, p, a, b) for lab, p, ms, vs in zip(m["labels"], m["prior"], m["mean"], m["var"]) for j, (a, b) in enumerate(zip(ms, vs))]
    return spark.createDataFrame(rows, "label int, j int, prior double, mean double, var double").select("label", "j", r6("prior").alias("prior"), r6("mean").alias("mean"), r6("var").alias("var"))


def gnb_predict(spark, sf):
    v = _vectors(spark, sf)
    return L.GaussianNaiveBayes().fit(v).predict(v).select("row_id", "prediction")


def _prices(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_quantity") / 50).alias("features"), (F.col("l_extendedprice") / 100000).alias("target"))


def linreg_fit(spark, sf):
    """Converged gradient descent is least squares."""
    m = L.LinearRegression(0.5, 4000).fit(_prices(spark, sf)).state
    return spark.createDataFrame([(m["weights"][0], m["bias"])], "slope double, intercept double").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def linreg_predict(spark, sf):
    p = _prices(spark, sf)
    return L.LinearRegression(0.5, 4000).fit(p).predict(p).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target", r6("prediction").alias("prediction"))


def _binary(spark, sf):
    return _vectors(spark, sf).withColumn("label", (F.col("label") == 0).cast("int"))


def logreg_predict(spark, sf):
    v = _binary(spark, sf)
    return L.LogisticRegression().fit(v).predict(v).select("row_id", "label", "prediction", r6("score").alias("score"))


def forest_classify(spark, sf):
    v = _vectors(spark, sf)
    return L.RandomForestClassifier().fit(v).predict(v).select("row_id", "label", "prediction")


def forest_regress(spark, sf):
    p = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_custkey").cast("double"), F.dayofyear("o_orderdate").cast("double")).alias("features"), F.col("o_totalprice").alias("target"))
    return L.RandomForestRegressor().fit(p).predict(p).select("row_id", "target", r6("prediction").alias("prediction"))


def mlp_predict(spark, sf):
    v = _binary(spark, sf)
    return L.MLPBinaryClassifier().fit(v).predict(v).select("row_id", "prediction", r6("score").alias("score"))


def kmeans_assign(spark, sf):
    v = _vectors(spark, sf)
    return L.MiniBatchKMeans(8).fit(v).predict(v).select("row_id", "label", "cluster")


def calibrated_predict(spark, sf):
    v = _binary(spark, sf)
    return S.CalibratedClassifierCV(L.LogisticRegression()).fit(v).predict(v).select("row_id", "label", r6("score").alias("score"))


def cross_val_nb(spark, sf):
    v = k_fold(_vectors(spark, sf), "row_id", 5)
    return S.cross_val_score(L.GaussianNaiveBayes, v, "accuracy").select("fold", r6("score").alias("score"))


_SCORINGS = ("accuracy", "f1", "mcc", "neg_log_loss", "neg_brier", "roc_auc", "pr_auc")


@dataclass
class _Given:
    """A model that says what the table already has, so that scores of folds can be checked against SQL."""

    def fit(self, df):
        return self

    def predict(self, df):
        return df


def cross_val_scorings(spark, sf):
    """Every classifier scoring over five folds, of scores and predictions that the table has."""
    d = _scored(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("y").alias("label"), "score", F.col("p").alias("prediction"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    out = None
    for s in _SCORINGS:
        one = S.cross_val_score(_Given, d, s).select("fold", F.lit(s).alias("scoring"), r6("score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def cross_val_regression(spark, sf):
    """r2, rmse, mae and mape of least squares over five folds of orders' lines."""
    p = _prices(spark, sf).withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))
    out = S.out_of_fold(lambda: L.LinearRegression(0.5, 4000), p)
    parts = [S.cross_val_score(_Given, out, s).select("fold", F.lit(s).alias("scoring"), r6("score").alias("score")) for s in ("r2", "neg_rmse", "neg_mae", "neg_mape")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def pipeline_predict(spark, sf):
    """Vectors scaled to [0, 1], then naive Bayes."""
    v = _vectors(spark, sf)
    return X.Pipeline([X.MinMaxScaler()], L.GaussianNaiveBayes(1e-12)).fit(v).predict(v).select("row_id", "prediction")


def grid_search_regressor(spark, sf):
    p = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_custkey") / 1000.0).alias("features"), (F.col("o_totalprice") / 100000).alias("target"))
    params, score, _ = S.grid_search(L.LinearRegression, p, {"learning_rate": [0.01, 0.1], "l2": [0.0, 0.1]}, "neg_rmse", 3)
    return spark.createDataFrame([(params["learning_rate"], params["l2"], round(score, 6))], "learning_rate double, l2 double, score double")


def threshold_tune(spark, sf):
    return S.tune_threshold(_scored(spark, sf), "y", "score", 1).select(r6("threshold").alias("threshold"), r6("value").alias("value"))


def permutation(spark, sf):
    v = _vectors(spark, sf)
    m = L.GaussianNaiveBayes().fit(v)
    return S.permutation_importance(m, v).select("feature", r6("importance").alias("importance"))


def sentiment_predict(spark, sf):
    """The quality labels as two sentiments, learned from a sample and applied to every document."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    known = d.join(read(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")
    return SentimentAnalyzer(5.0, 100).fit(known).predict(d).select("row_id", "prediction", r6("score").alias("score"))


QUERIES = {f.__name__: f for f in (knn_predict, knn_neighbours, gnb_fit, gnb_predict, linreg_fit, linreg_predict, logreg_predict, forest_classify, forest_regress, mlp_predict, kmeans_assign, calibrated_predict, cross_val_nb, cross_val_scorings, cross_val_regression, pipeline_predict, grid_search_regressor, threshold_tune, permutation, sentiment_predict)}

_E = "e as (select vec_id as row_id, label, cast(embedding as double[]) v from embeddings)"
_NEAR = f"""{_E}, d as (select a.row_id, b.row_id as neighbour, b.label, list_distance(a.v, b.v) dist from e a join e b on a.row_id <> b.row_id),
    k as (select *, row_number() over (partition by row_id order by dist, neighbour) rank from d qualify rank <= 3)"""
_NB = f"""{_E}, x as (select row_id, label, unnest(v) x, generate_subscripts(v, 1) - 1 as j from e),
    f as (select label, j, avg(x) mean, greatest(var_samp(x), 1e-9) var from x group by label, j), p as (select label, count(*) / sum(count(*)) over () prior, min(row_id) o from e group by label)"""
_LS = "s as (select regr_slope(l_extendedprice / 100000, l_quantity / 50) slope, regr_intercept(l_extendedprice / 100000, l_quantity / 50) intercept from lineitem)"

_LINES = "x as (select l_orderkey % 5 as fold, l_quantity / 50 as q, l_extendedprice / 100000 as t from lineitem), ls as (select k.fold, regr_slope(t, q) s, regr_intercept(t, q) i from x join (select distinct fold from x) k on x.fold <> k.fold group by k.fold), pr as (select fold, t, s * q + i as p from x join ls using (fold))"

ORACLE_SQL = {
    "cross_val_scorings": f"""with {_SCORED}, o as (select y as pos from d order by doc_id limit 1), z as (select d.doc_id, cast(d.doc_id % 5 as int) as fold, score, (y = pos)::int as y, (p = pos)::int as p, greatest(1e-15, least(1 - 1e-15, score)) q from d, o),
        c as (select fold, count(*) filter (y = 1 and p = 1)::double tp, count(*) filter (y = 0 and p = 1)::double fp, count(*) filter (y = 1 and p = 0)::double fn, count(*) filter (y = 0 and p = 0)::double tn, avg(ln(case when y = 1 then q else 1 - q end)) ll, -avg((score - y) * (score - y)) br from z group by fold),
        r as (select fold, y, row_number() over w rn, sum(y) over w tp, sum(y) over (partition by fold) np, count(*) over (partition by fold) n from z window w as (partition by fold order by score desc, doc_id rows unbounded preceding)),
        s as (select fold, 'accuracy' scoring, (tp + tn) / (tp + fp + fn + tn) v from c union all select fold, 'f1', 2 * tp / (2 * tp + fp + fn) from c union all select fold, 'mcc', coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) from c
        union all select fold, 'neg_log_loss', ll from c union all select fold, 'neg_brier', br from c union all select fold, 'roc_auc', sum(case when y = 0 then tp / (np::double * (n - np)) end) from r group by fold
        union all select fold, 'pr_auc', sum((tp / rn::double + case when rn = 1 then 1 else (tp - 1) / (rn - 1)::double end) / 2 / np) from r where y = 1 group by fold)
        select fold, scoring, round(v, 6) as score from s""",
    "cross_val_regression": f"""with {_LINES}, m as (select fold, avg((t - p) ** 2) e, avg(abs(t - p)) a, avg(abs(t - p) / greatest(abs(t), 1e-12)) pe, var_pop(t) v from pr group by fold)
        select cast(fold as int) as fold, scoring, round(case scoring when 'r2' then 1 - e / v when 'neg_rmse' then -sqrt(e) when 'neg_mae' then -a else -pe end, 6) as score from m, (select unnest(['r2', 'neg_rmse', 'neg_mae', 'neg_mape']) scoring)""",
    "pipeline_predict": f"""with {_E}, x0 as (select row_id, label, unnest(v) x, generate_subscripts(v, 1) - 1 as j from e), b as (select j, min(x) lo, max(x) hi from x0 group by j), x as (select row_id, label, j, (x - lo) / (hi - lo) x from x0 join b using (j)),
        f as (select label, j, avg(x) mean, greatest(var_samp(x), 1e-12) var from x group by label, j), p as (select label, count(*) / sum(count(*)) over () prior, min(row_id) o from e group by label),
        l as (select row_id, f.label, o, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * var) - (x - mean) ** 2 / (2 * var)) lp from x join f using (j) join p on p.label = f.label group by row_id, f.label, o)
        select row_id, label as prediction from l qualify row_number() over (partition by row_id order by lp desc, o) = 1""",
    "knn_predict": f"""with {_NEAR}, v as (select row_id, label, sum(1 / (dist + 1e-12)) votes, min(dist) nearest from k group by row_id, label)
        select row_id, label as prediction from v qualify row_number() over (partition by row_id order by votes desc, nearest, cast(label as varchar)) = 1""",
    "knn_neighbours": f"with {_NEAR} select row_id, cast(rank as int) as rank, neighbour, label, round(dist, 6) as distance from k",
    "gnb_fit": f"with {_NB} select label, cast(j as int) as j, round(prior, 6) as prior, round(mean, 6) as mean, round(var, 6) as var from f join p using (label)",
    "gnb_predict": f"""with {_NB}, l as (select row_id, f.label, o, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * var) - (x - mean) ** 2 / (2 * var)) lp from x join f using (j) join p on p.label = f.label group by row_id, f.label, o)
        select row_id, label as prediction from l qualify row_number() over (partition by row_id order by lp desc, o) = 1""",
    "linreg_fit": f"with {_LS} select round(slope, 6) as slope, round(intercept, 6) as intercept from s",
    "linreg_predict": f"with {_LS} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 100000 as target, round(slope * (l_quantity / 50) + intercept, 6) as prediction from lineitem, s",
    "cross_val_nb": f"""with {_E}, w as (select *, cast(ntile(5) over (order by {draw_sql(42, 'row_id')}, row_id) - 1 as int) as fold from e), x as (select row_id, label, fold, unnest(v) x, generate_subscripts(v, 1) j from w),
        f as (select k.fold, label, j, avg(x) mean, greatest(var_samp(x), 1e-9) var from x join (select distinct fold from w) k on x.fold <> k.fold group by all),
        p as (select k.fold, label, count(*) / sum(count(*)) over (partition by k.fold) prior, min(row_id) o from w join (select distinct fold from w) k on w.fold <> k.fold group by k.fold, label),
        l as (select row_id, x.label truth, x.fold, f.label, o, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * var) - (x - mean) ** 2 / (2 * var)) lp from x join f using (fold, j) join p on p.label = f.label and p.fold = x.fold group by all),
        b as (select fold, truth, label from l qualify row_number() over (partition by row_id order by lp desc, o) = 1)
        select fold, round(avg((truth = label)::int), 6) as score from b group by fold""",
    "threshold_tune": f"""with {_SCORED}, t as (select i / 100.0::double t from range(101) r(i)), c as (select t, count(*) filter (score >= t and y = 1)::double tp, count(*) filter (score >= t and y <> 1) fp, count(*) filter (score < t and y = 1) fn from d, t group by t)
        select round(t, 6) as threshold, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as value from c order by value desc, t limit 1""",
}
