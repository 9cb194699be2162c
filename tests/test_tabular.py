import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import metrics as M
from loomspark.functions import vectors as V
from loomspark.operators import features as X
from loomspark.operators import models as L
from loomspark.operators import selection as S
from loomspark.operators import splits as P
from loomspark.operators.base import InvalidArgument, NotTrained, Parametric, SerializationError
from loomspark.operators.ordering import ranked


def table(spark, rows, labels=None, name="label"):
    cols = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    if labels is None:
        return spark.createDataFrame(cols, "row_id long, features array<double>")
    kind = "string" if isinstance(labels[0], str) else "double" if isinstance(labels[0], float) else "int"
    return spark.createDataFrame([(*c, y) for c, y in zip(cols, labels)], f"row_id long, features array<double>, {name} {kind}")


def features(df):
    return [list(r.features) for r in df.orderBy("row_id").collect()]


def predictions(df):
    return [r.prediction for r in df.orderBy("row_id").collect()]


def test_ranked_matches_sorting(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, *range(12)]), r.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v long, g string")
    key = lambda x: (x[1] is not None, x[1] or 0, x[0])
    got = {x.i: (x.rn, x.s) for x in ranked(df, F.col("v"), ["i"], sums={"s": F.col("i")}, buckets=5).collect()}
    total = 0
    for n, x in enumerate(sorted(rows, key=key)):
        total += x[0]
        assert got[x[0]] == (n + 1, total)
    got = {x.i: x.rn for x in ranked(df, F.col("v"), ["i"], descending=True, within=["g"], buckets=4).collect()}
    for g in "ab":
        mine = sorted((x for x in rows if x[2] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        assert [got[x[0]] for x in mine] == list(range(1, len(mine) + 1))
    assert ranked(df.limit(0), F.col("v"), ["i"]).collect() == []


def test_splits(spark):
    df = spark.createDataFrame([(i, i * 7 % 3) for i in range(23)], "i long, y int")
    t = P.train_test_split(df, "i").collect()
    assert sum(x.is_test for x in t) == 4 and len(t) == 23
    folds = P.k_fold(df, "i", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [x["count"] for x in folds] == [5, 5, 5, 4, 4]
    for y in range(3):
        sizes = [x["count"] for x in P.stratified_k_fold(df, "i", "y", 4).where(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1
    ts = P.time_series_split(df.where("i < 12"), "i", [], 3, 2).collect()
    for s in range(3):
        train, test = ([x.i for x in ts if x.split == s and x.role == r] for r in ("train", "test"))
        assert len(test) == 2 and max(train) < min(test)
    assert [x.i for x in P.stride_sample(df, "i", [], 6).orderBy("i").collect()] == [0, 4, 8, 12, 16, 20]
    times = [x.times for x in P.bootstrap_weights(spark.range(4000).withColumnRenamed("id", "i"), "i").collect()]
    assert abs(np.mean(times) - 1) < 0.06 and abs(np.mean(np.array(times) == 0) - math.exp(-1)) < 0.03
    with pytest.raises(ValueError):
        P.train_test_split(df, "i", 1.5)


def test_scalers_and_encoders(spark):
    scale3 = table(spark, [[1, 10], [2, 20], [3, 30]])
    assert features(X.MinMaxScaler().fit_transform(scale3)) == [[0, 0], [0.5, 0.5], [1, 1]]
    assert features(X.StandardScaler().fit_transform(scale3)) == [[-1, -1], [0, 0], [1, 1]]
    same = table(spark, [[5], [5]])
    assert features(X.MinMaxScaler().fit_transform(same)) == [[0], [0]] == features(X.StandardScaler().fit_transform(same))
    holes = table(spark, [[1, math.nan], [2, 4], [3, 6]])
    assert features(X.SimpleImputer().fit_transform(holes))[0] == [1, 5] == features(X.SimpleImputer("median").fit_transform(holes))[0]
    assert features(X.SimpleImputer().fit_transform(table(spark, [[math.nan]]))) == [[0]]
    assert features(X.PolynomialFeatures().fit_transform(table(spark, [[2, 3]]))) == [[2, 3, 4, 6, 9]]
    shirts = spark.createDataFrame([(0, ["red", "S"]), (1, ["blue", "M"]), (2, ["red", "M"])], "row_id long, features array<string>")
    enc = X.OneHotEncoder().fit(shirts)
    assert features(enc.transform(shirts)) == [[1, 0, 1, 0], [0, 1, 0, 1], [1, 0, 0, 1]]
    assert features(enc.transform(spark.createDataFrame([(0, ["green", "M"])], shirts.schema))) == [[0, 0, 0, 1]]
    with pytest.raises(NotTrained):
        X.MinMaxScaler().transform(scale3)
    with pytest.raises(InvalidArgument):
        X.MinMaxScaler().fit(scale3.limit(0))


def test_pca_finds_the_leading_directions(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 4)) @ np.diag([3, 2, 0.5, 0.1]) @ np.linalg.qr(r.normal(size=(4, 4)))[0]
    got = np.array(features(X.PCA(2, 200).fit_transform(table(spark, x.tolist()))))
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(np.abs(got) - np.abs(u[:, :2] * s[:2])).max() < 1e-3


def test_classifiers(spark):
    knn = L.KNearestNeighbors(3).fit(table(spark, [[1, 1], [1, 2], [4, 4], [5, 5]], list("AABB")))
    assert predictions(knn.predict(table(spark, [[4.5, 4.0]]))) == ["B"]
    logic = [[0, 0], [0, 1], [1, 0], [1, 1]]
    lr = L.LogisticRegression().fit(table(spark, logic, [0, 1, 1, 1]))
    assert predictions(lr.predict(table(spark, [[1, 1], [0, 0]]))) == [1, 0]
    mlp = L.MLPBinaryClassifier().fit(table(spark, logic, [0, 0, 0, 1]))
    assert predictions(mlp.predict(table(spark, [[1, 1], [0, 0]]))) == [1, 0]
    nb = L.GaussianNaiveBayes().fit(table(spark, [[1.0, 20.0], [1.2, 19.5], [3.5, 5.0], [3.7, 4.8]], ["cold", "cold", "hot", "hot"]))
    assert predictions(nb.predict(table(spark, [[3.6, 5.1], [1.1, 19.8]]))) == ["hot", "cold"]
    six = table(spark, [[1, 1], [1, 2], [2, 1], [4, 4], [5, 5], [4, 5]], list("AAABBB"))
    assert predictions(L.RandomForestClassifier().fit(six).predict(table(spark, [[4.8, 4.8]]))) == ["B"]
    pipe = X.Pipeline([X.StandardScaler()], L.KNearestNeighbors(3)).fit(six)
    assert predictions(pipe.predict(table(spark, [[4.8, 4.6]]))) == ["B"]


def test_knn_matches_brute_force(spark):
    r = np.random.default_rng(4)
    x, y = r.integers(0, 6, (150, 2)).astype(float), r.integers(0, 3, 150)
    q = r.integers(0, 6, (40, 2)).astype(float)
    train = table(spark, x.tolist(), [int(v) for v in y])
    model = L.KNearestNeighbors(5, block=32).fit(train)
    got = dict(model.predict(table(spark, q.tolist())).collect())
    for i, p in enumerate(q):
        d = np.sqrt(((x - p) ** 2).sum(1))
        near = sorted(range(150), key=lambda j: (d[j], j))[:5]
        votes = {c: (sum(1 / (d[j] + 1e-12) for j in near if y[j] == c), min(d[j] for j in near if y[j] == c)) for c in {y[j] for j in near}}
        assert got[i] == min(votes, key=lambda c: (-votes[c][0], votes[c][1], str(c)))


def test_regressors(spark):
    lin = table(spark, [[1], [2], [3], [4], [5]], [2.0, 4.0, 6.0, 8.0, 10.0], "target")
    m = L.LinearRegression().fit(lin)
    assert abs(predictions(m.predict(table(spark, [[6]])))[0] - 12) < 0.2
    w, b = 0.0, 0.0
    xs, ys = np.arange(1, 6.0), 2 * np.arange(1, 6.0)
    for _ in range(2000):  # the steps themselves
        e = w * xs + b - ys
        w, b = w - 0.01 * (e * xs).mean(), b - 0.01 * e.mean()
    assert abs(m.state["weights"][0] - w) < 1e-9 and abs(m.state["bias"] - b) < 1e-9
    rf = table(spark, [[1], [2], [3], [4], [5], [6]], [2.0, 4.0, 6.1, 8.0, 10.1, 12.0], "target")
    assert predictions(L.RandomForestRegressor().fit(rf).predict(table(spark, [[5.8]])))[0] > 8


def test_kmeans_and_selection(spark):
    km = L.MiniBatchKMeans(2).fit(table(spark, [[0, 0.1], [0.1, 0], [5, 5.1], [5.2, 5]]))
    a, b, c, d = (x.cluster for x in km.predict(table(spark, [[0, 0.1], [0.1, 0], [5, 5.1], [5.2, 5]])).orderBy("row_id").collect())
    assert a == b != c == d
    six = table(spark, [[0, 0], [0, 1], [1, 0], [1, 1], [0.9, 0.9], [0.1, 0.2]], [0, 1, 1, 1, 1, 0])
    folded = P.k_fold(six, "row_id", 3)
    assert len(S.cross_val_score(L.GaussianNaiveBayes, folded, "accuracy").collect()) == 3
    cal = S.CalibratedClassifierCV(L.LogisticRegression(iterations=50), 2).fit(six)
    assert all(0 <= x.score <= 1 for x in cal.predict(six).collect())
    lin = table(spark, [[1], [2], [3], [4], [5], [6]], [2.0, 4.1, 5.9, 8.2, 10.1, 12.0], "target")
    params, score, model = S.grid_search(lambda **k: L.LinearRegression(iterations=500, **k), lin, {"learning_rate": [0.001, 0.02]}, "r2", 3)
    assert params == {"learning_rate": 0.02} and score > 0.8 and predictions(model.predict(table(spark, [[6]])))[0] > 11
    imp = dict(S.permutation_importance(L.GaussianNaiveBayes().fit(six), six, 2).collect())
    assert set(imp) == {0, 1}


def test_permutation_importance_of_all_features(spark, tmp_path):
    import random

    from loomspark.operators.base import Classifier
    from loomspark.operators.ordering import draw, ranked
    from loomspark.plans import catalog

    r = random.Random(3)
    rows = [(i, [float(r.gauss(2.0 * (i % 3) * (j in (0, 6)), 1)) for j in range(7)], i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = dict(catalog.queries()["permutation"](spark, str(tmp_path)).collect())
    assert set(got) == set(range(7)) and got[6] > 0.05 and max(abs(got[j]) for j in range(1, 6)) < got[6]
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id as row_id", "cast(embedding as array<double>) as features", "label")
    model = L.GaussianNaiveBayes().fit(v)
    data = [(x.row_id, list(x.features), x.label) for x in v.orderBy("row_id").collect()]
    share = lambda ds: sum(a.label == a.prediction for a in model.predict(spark.createDataFrame(ds, v.schema)).collect()) / len(ds)
    base = share(data)
    for j in (0, 6):
        drop = 0.0
        for k in range(3):
            order = [x.rn for x in ranked(v, draw(f"42-{j}-{k}", "row_id"), ["row_id"]).orderBy("row_id").collect()]
            value = {rn: x[1][j] for rn, x in zip(order, data)}
            drop += base - share([(i, [value[n + 1] if c == j else y for c, y in enumerate(f)], lab) for n, (i, f, lab) in enumerate(data)])
        assert abs(got[j] - drop / 3) < 1e-5
    swaps = v.selectExpr("row_id", "features", "label", "array(named_struct('j', 6, 'v', 1.5D), named_struct('j', 0, 'v', -9D)) as s")
    both = [{(x.row_id, x.swap.j): x.prediction for x in f(swaps, "s").collect()} for f in (model.predict_swapped, lambda a, b: Classifier.predict_swapped(model, a, b))]
    assert both[0] == both[1] and len(both[0]) == 180


def test_metrics_by_hand(spark):
    rows = [(i, t, p, s) for i, (t, p, s) in enumerate(zip([1, 0, 1, 0, 1, 0], [1, 0, 1, 1, 1, 0], [0.9, 0.2, 0.8, 0.6, 0.7, 0.1]))]
    d = spark.createDataFrame(rows, "i int, y int, p int, s double")
    got = d.agg(M.accuracy("y", "p"), M.precision("y", "p", 1), M.recall("y", "p", 1), M.f1("y", "p", 1), M.matthews("y", "p", 1)).first()
    assert [round(x, 6) for x in got] == [0.833333, 0.75, 1.0, 0.857143, 0.707107]
    assert M.roc_auc(d, "y", "s", 1, ["i"]).first()[0] == 1.0 == M.pr_auc(d, "y", "s", 1, ["i"]).first()[0]
    assert M.roc_auc(d.where("y = 1"), "y", "s", 1, ["i"]).first()[0] == 0.0
    assert {tuple(r) for r in M.confusion_matrix(d, "y", "p").collect()} == {(0, 0, 2), (0, 1, 1), (1, 0, 0), (1, 1, 3)}
    assert {(r.label, r.support) for r in M.classification_report(d, "y", "p").collect()} == {(0, 3), (1, 3)}
    m = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (400.0, 420.0)], "y double, p double").agg(M.mape("y", "p"), M.rmse("y", "p")).first()
    assert abs(m[0] - 0.25 / 3) < 1e-9 and abs(m[1] - math.sqrt(300)) < 1e-9
    t = S.tune_threshold(spark.createDataFrame(list(zip([1, 0, 1, 0, 1, 0], [0.9, 0.6, 0.8, 0.3, 0.7, 0.2])), "y int, s double"), "y", "s", 1, steps=21).first()
    assert 0.6 < t.threshold <= 0.7 and t.value == 1.0


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([0.0], [1.0]), ([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = d.select(V.cosine("a", "b"), V.euclidean("a", "b"), V.dot("a", "b")).collect()
    assert abs(got[0][0] - 1) < 1e-12 and got[1][0] == 0 and got[2][1] == 5 and got[0][2] == 14
    s = spark.range(1).select(V.sigmoid(F.lit(-800.0)), V.sigmoid(F.lit(800.0)), V.sigmoid(F.lit(0.0))).first()
    assert tuple(s) == (0.0, 1.0, 0.5)


def test_models_survive_saving(spark, tmp_path):
    lin = table(spark, [[1], [2], [3]], [2.0, 4.0, 6.0], "target")
    m = L.LinearRegression().fit(lin)
    m.save(f"{tmp_path}/m.json")
    again = L.LinearRegression.load(f"{tmp_path}/m.json")
    assert predictions(again.predict(lin)) == predictions(m.predict(lin))
    with pytest.raises(SerializationError):
        L.KNearestNeighbors.load(f"{tmp_path}/m.json")
    assert m.with_params(iterations=5).get_params()["iterations"] == 5 and Parametric.from_dict(m.to_dict()).state == m.state
    with pytest.raises(InvalidArgument):
        m.with_params(nothing=1)
