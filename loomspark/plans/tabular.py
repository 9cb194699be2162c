"""Queries: splits, feature transforms and metrics over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import vectors as V
from ..operators import features as X
from ..operators import splits as P
from ..operators.ordering import draw_sql
from ..workers import ready


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)  # before any UDF is made
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def _items(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_extendedprice", "l_discount").alias("features"))


def _spread(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(F.col("features")[j]).alias(n) for j, n in enumerate(("quantity", "price", "discount"))])


def standard_scale(spark, sf):
    items = _items(spark, sf)
    return _spread(X.StandardScaler().fit(items).transform(items))


def minmax_scale(spark, sf):
    items = _items(spark, sf)
    return _spread(X.MinMaxScaler().fit(items).transform(items))


def _holes(spark, sf):
    price = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))
    return read(spark, sf, "orders").select("o_orderkey", F.array(price).alias("features"))


def impute_median(spark, sf):
    d = _holes(spark, sf)
    return X.SimpleImputer("median").fit(d).transform(d).select("o_orderkey", r6(F.col("features")[0]).alias("price"))


def impute_mean(spark, sf):
    d = _holes(spark, sf)
    return X.SimpleImputer().fit(d).transform(d).select("o_orderkey", F.round(F.col("features")[0], 2).alias("price"))


def one_hot_segment(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.array("c_mktsegment").alias("features"))
    return X.OneHotEncoder().fit(c).transform(c).select(F.col("row_id").alias("c_custkey"), F.concat_ws("", F.transform("features", lambda x: x.cast("int").cast("string"))).alias("code"))


def poly_features(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array("l_quantity", "l_discount").alias("features"))
    x = F.col("features")
    return X.PolynomialFeatures().fit(d).transform(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[r6(x[j]).alias(n) for j, n in enumerate(("q", "d", "qq", "qd", "dd"))])


def pca_embeddings(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return X.PCA(2).fit(d).transform(d).select("vec_id", r6(F.col("features")[0]).alias("pc1"), r6(F.col("features")[1]).alias("pc2"))


def train_test_split(spark, sf):
    return P.train_test_split(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def kfold_assign(spark, sf):
    return P.k_fold(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def stratified_fold(spark, sf):
    return P.stratified_k_fold(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


def ts_split(spark, sf):
    return P.time_series_split(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "split", "role")


def bootstrap(spark, sf):
    return P.bootstrap_weights(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def stride_sample(spark, sf):
    return P.stride_sample(read(spark, sf, "events").select("event_id", "event_type"), "event_id", [], 1000)


def _scored(spark, sf):
    """Labelled documents with a score from their length, and a decision."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 100) / 100).alias("score")).withColumn("p", (F.col("score") >= 0.5).cast("int"))


def classification_metrics(spark, sf):
    return _scored(spark, sf).agg(
        r6(M.accuracy("y", "p")).alias("accuracy"), r6(M.precision("y", "p", 1)).alias("precision_1"), r6(M.recall("y", "p", 1)).alias("recall_1"),
        r6(M.f1("y", "p", 1)).alias("f1"), r6(M.matthews("y", "p", 1)).alias("mcc"), r6(M.log_loss("y", "score", 1)).alias("log_loss"), r6(M.brier("y", "score", 1)).alias("brier"),
    )


def roc_auc(spark, sf):
    return M.roc_auc(_scored(spark, sf), "y", "score", 1, ["doc_id"]).select(r6("roc_auc").alias("roc_auc"))


def pr_auc(spark, sf):
    return M.pr_auc(_scored(spark, sf), "y", "score", 1, ["doc_id"]).select(r6("pr_auc").alias("pr_auc"))


def class_report(spark, sf):
    return M.classification_report(_scored(spark, sf), "y", "p").select("label", r6("precision").alias("prec"), r6("recall").alias("rec"), r6("f1").alias("f1"), "support")


def confusion(spark, sf):
    return M.confusion_matrix(_scored(spark, sf), "y", "p")


def reg_metrics(spark, sf):
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"))
    d = read(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_totalprice") / 1000).alias("y"), (F.col("s") / 1000).alias("p"))
    return d.agg(*[F.round(f("y", "p"), 4).alias(n) for n, f in (("mse", M.mse), ("rmse", M.rmse), ("mae", M.mae), ("r2", M.r2), ("mape", M.mape))])


def vector_math(spark, sf):
    """Each vector against the mean vector of its label."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = e.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    j = e.join(mean, "label")
    return j.select("vec_id", r6(V.dot("v", "c")).alias("dot"), r6(V.euclidean("v", "c")).alias("dist"), r6(V.cosine("v", "c")).alias("cos"), r6(V.sigmoid(V.dot("v", "c"))).alias("sig"))


QUERIES = {f.__name__: f for f in (standard_scale, minmax_scale, impute_median, impute_mean, one_hot_segment, poly_features, pca_embeddings, train_test_split, kfold_assign, stratified_fold, ts_split, bootstrap, stride_sample, classification_metrics, roc_auc, pr_auc, class_report, confusion, reg_metrics, vector_math)}

_D = draw_sql(42, "o_orderkey")
_POISSON = " ".join(f"when u < {c} then {i}" for i, c in enumerate(P.POISSON))
_SCORED = "d as (select doc_id, quality as y, (n_chars % 100) / 100.0::double as score, cast((n_chars % 100) / 100.0::double >= 0.5 as int) as p from documents join labels using (doc_id))"
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

ORACLE_SQL = {
    "standard_scale": f"""select {_KEYS}, round((l_quantity - mq) / sq, 6) as quantity, round((l_extendedprice - mp) / sp, 6) as price, round((l_discount - md) / sd, 6) as discount
        from lineitem, (select avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) mp, stddev_samp(l_extendedprice) sp, avg(l_discount) md, stddev_samp(l_discount) sd from lineitem)""",
    "minmax_scale": f"""select {_KEYS}, round((l_quantity - aq) / (bq - aq), 6) as quantity, round((l_extendedprice - ap) / (bp - ap), 6) as price, round((l_discount - ad) / (bd - ad), 6) as discount
        from lineitem, (select min(l_quantity) aq, max(l_quantity) bq, min(l_extendedprice) ap, max(l_extendedprice) bp, min(l_discount) ad, max(l_discount) bd from lineitem)""",
    "impute_median": "with m as (select median(o_totalprice) m from orders where o_orderstatus <> 'P') select o_orderkey, round(case when o_orderstatus = 'P' then m else o_totalprice end, 6) as price from orders, m",
    "impute_mean": "with m as (select avg(o_totalprice) m from orders where o_orderstatus <> 'P') select o_orderkey, round(case when o_orderstatus = 'P' then m else o_totalprice end, 2) as price from orders, m",
    "one_hot_segment": """with f as (select c_mktsegment, row_number() over (order by min(c_custkey)) as nth, count(*) over () as n from customer group by c_mktsegment)
        select c_custkey, repeat('0', cast(nth - 1 as int)) || '1' || repeat('0', cast(n - nth as int)) as code from customer join f using (c_mktsegment)""",
    "poly_features": f"""select {_KEYS}, l_extendedprice, round(l_quantity, 6) as q, round(l_discount, 6) as d, round(l_quantity * l_quantity, 6) as qq, round(l_quantity * l_discount, 6) as qd, round(l_discount * l_discount, 6) as dd from lineitem""",
    "train_test_split": f"""with n as (select count(*) n from orders), r as (select o_orderkey, row_number() over (order by {_D}, o_orderkey) rn from orders)
        select o_orderkey, rn > n - greatest(1, floor(n * 0.2)) as is_test from r, n""",
    "kfold_assign": f"select o_orderkey, cast(ntile(5) over (order by {_D}, o_orderkey) - 1 as int) as fold from orders",
    "stratified_fold": f"select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus order by {_D}, o_orderkey) - 1) % 5 as int) as fold from orders",
    "ts_split": """with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) rn, count(*) over () // 6 as t from orders)
        select o_orderkey, cast(s as int) as split, case when rn <= (s + 1) * t then 'train' else 'test' end as role from r, range(5) x(s) where rn <= (s + 2) * t""",
    "bootstrap": f"select o_orderkey, cast(case {_POISSON} else {len(P.POISSON)} end as int) as times from (select o_orderkey, {_D} u from orders)",
    "stride_sample": """select event_id, event_type from (select event_id, event_type, row_number() over (order by event_id) rn, count(*) over () n from events)
        where (rn - 1) % greatest(1, cast(ceil(n / 1000) as bigint)) = 0""",
    "classification_metrics": f"""with {_SCORED}, c as (select count(*) filter (y = 1 and p = 1)::double tp, count(*) filter (y <> 1 and p = 1)::double fp, count(*) filter (y = 1 and p <> 1)::double fn, count(*) filter (y <> 1 and p <> 1)::double tn,
        avg(-ln(case when y = 1 then q else 1 - q end)) ll, avg((score - y) * (score - y)) br from (select *, greatest(1e-15, least(1 - 1e-15, score)) q from d))
        select round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision_1, round(tp / (tp + fn), 6) as recall_1, round(2 * tp / (2 * tp + fp + fn), 6) as f1,
        round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round(ll, 6) as log_loss, round(br, 6) as brier from c""",
    "roc_auc": f"""with {_SCORED}, r as (select y, sum(y) over (order by score desc, doc_id rows unbounded preceding) tp, sum(y) over () p, count(*) over () n from d)
        select round(sum(case when y = 0 then tp / (cast(p as double) * (n - p)) end), 6) as roc_auc from r""",
    "pr_auc": f"""with {_SCORED}, r as (select y, sum(y) over w tp, row_number() over (order by score desc, doc_id) rn, sum(y) over () p from d window w as (order by score desc, doc_id rows unbounded preceding)),
        q as (select y, p, tp / rn::double pr, lag(tp / rn::double, 1, 1.0) over (order by rn) before from r) select round(sum((pr + before) / 2 / p), 6) as pr_auc from q where y = 1""",
    "class_report": f"""with {_SCORED}, l as (select y as label from d union select p from d), c as (select label, count(*) filter (y = label and p = label)::double tp, count(*) filter (y = label) support, count(*) filter (p = label) said from d, l group by label)
        select label, round(case when said = 0 then 0 else tp / said end, 6) as prec, round(case when support = 0 then 0 else tp / support end, 6) as rec, round(2 * tp / (said + support), 6) as f1, support from c""",
    "confusion": f"""with {_SCORED}, l as (select y as label from d union select p from d) select a.label as actual, b.label as predicted, count(d.y) as n from l a cross join l b left join d on d.y = a.label and d.p = b.label group by all""",
    "reg_metrics": """with s as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) s from lineitem group by l_orderkey), d as (select o_totalprice / 1000 y, s / 1000 p from orders join s on o_orderkey = l_orderkey)
        select round(avg((y - p) ** 2), 4) as mse, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(avg(abs(y - p)), 4) as mae, round(1 - avg((y - p) ** 2) / var_pop(y), 4) as r2, round(avg(abs(y - p) / greatest(abs(y), 1e-12)), 4) as mape from d""",
    "vector_math": """with e as (select vec_id, label, cast(embedding as double[]) v from embeddings), x as (select vec_id, label, unnest(v) a, generate_subscripts(v, 1) i from e), m as (select label, i, avg(a) c from x group by label, i),
        s as (select vec_id, sum(a * c) dp, sqrt(sum((a - c) ** 2)) dist, sum(a * c) / (sqrt(sum(a * a)) * sqrt(sum(c * c))) co from x join m using (label, i) group by vec_id)
        select vec_id, round(dp, 6) as dot, round(dist, 6) as dist, round(co, 6) as cos, round(1 / (1 + exp(-dp)), 6) as sig from s""",
}
