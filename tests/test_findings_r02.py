"""Claims of a review round: memory of workers, growth of work, ties."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomspark import workers
from loomspark.operators import nlp as N


def test_word_offsets_hold_little(spark, monkeypatch):
    """A batch of texts is never a list of dictionaries: it comes in slices, as Arrow arrays."""
    assert list(workers.slices(pa.array(["a" * workers.SLICE_BYTES, None, "b", "c" * 2 * workers.SLICE_BYTES, "d"]))) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(workers.slices(pa.array([], pa.string()))) == []
    texts = ["élan vital, 12 d'or", None, "", "x" * 10 + " y"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = [None if r.w is None else [tuple(x) for x in r.w] for r in d.select("i", N.word_offsets("text").alias("w")).orderBy("i").collect()]
    assert got == [[("élan", 0, 4), ("vital", 5, 10), ("d'or", 15, 19)], None, [], [("x" * 10, 0, 10), ("y", 11, 12)]]


def test_rows_of_texts_come_in_slices(spark, monkeypatch):
    """However many texts a batch has, a slice of them is rows in Python at once."""
    seen = []
    monkeypatch.setattr(N, "rows_by_slices", lambda df, key, text, run, schema: seen.append(run) or df)
    d = spark.createDataFrame([(1, "Paris x"), (2, None), (3, "")], "i int, text string")
    N.per_text(d, "i", "text", lambda t: [(len(t), t)], "n int, t string")
    assert seen[0]([1, 2, 3], ["ab", None, ""]).to_pylist() == [{"i": 1, "n": 2, "t": "ab"}, {"i": 3, "n": 0, "t": ""}]
    assert seen[0]([2], [None]).num_rows == 0


def test_keywords_that_tie_keep_the_order_of_the_text():
    """Sums of equal scores differ in the last place; SQL ranks scores rounded to six places."""
    assert [k for k, _ in N.rake("q t q of s q of t t", frozenset(["of"]), 10)] == ["q t q", "s q", "t t"]
    assert [k for k, _ in N.rake("q r u v of t s t s of v p of t v", frozenset(["of"]), 10)][:2] == ["q r u v", "t s t s"]


def _squares(spark):
    from loomspark.operators.geo import Geo

    countries = spark.createDataFrame([(f"C{i}", f"A{i}", f"A{i}X", "1") for i in range(5)], "name string, iso2 string, iso3 string, phone_code string")
    states = spark.createDataFrame([], "name string, state_code string, iso2 string")
    places = spark.createDataFrame([], "cca2 string, name string, lat double, lon double")
    cities = spark.createDataFrame([(i * 10 + j, f"t{i}{j}", f"A{i}", "0", i * 10.0 + j, i * 10.0 - j) for i in range(5) for j in range(6)], "city_id int, name string, country_code string, state_code string, lat double, lon double")
    points = spark.createDataFrame([(i, i * 0.4, i * 0.4) for i in range(100)] + [(5, 2.0, 2.0)], "k int, lat double, lon double")
    return Geo(countries, states, places, cities), points


def test_countries_meet_a_point_in_its_row(spark):
    """No row for each point and country: a sort of those was held by one task."""
    geo, points = _squares(spark)
    got = geo.country_of(points, "k")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan and got.count() == 100
    assert {r.k: r.iso2 for r in got.collect()}[50] == "A2"


def test_only_the_nearest_leave_the_worker(spark):
    """Of the 20 candidates in degrees only those asked for are sorted by key."""
    from loomspark.operators import geo as G

    geo, points = _squares(spark)
    made = G.nearest(points.where("k < 10"), "k", geo.cities, "city_id", 20, False, 3)
    assert made.count() == 3 * 11
    assert made.where("k = 7").orderBy("rank").select("city_id").collect() == geo.nearest_cities(points, "k", 3).where("k = 7").orderBy("rank").select("city_id").collect()


def test_folds_of_sums_that_add_up(spark, monkeypatch):
    """Least squares looks at the rows once for all folds and all points of a grid, and finds what fits of its own find."""
    import numpy as np

    from loomspark.operators import models as L
    from loomspark.operators import selection as S

    rows = [(i, [i % 7 / 7, i % 3 / 3], i % 7 / 2 + i % 3 + 1.0, i % 3) for i in range(60)]
    d = spark.createDataFrame(rows, "row_id long, features array<double>, target double, fold int")
    calls, real = [], L.LinearRegression.statistics
    monkeypatch.setattr(L.LinearRegression, "statistics", staticmethod(lambda *a: calls.append(a) or real(*a)))
    make = lambda: L.LinearRegression(0.1, 50)
    got = {r.row_id: r.prediction for r in S.out_of_fold(make, d.repartition(16, "fold")).collect()}  # some tasks without rows
    assert len(calls) == 1
    own = {r.row_id: r.prediction for k in range(3) for r in make().fit(d.where(f"fold <> {k}")).predict(d.where(f"fold = {k}")).collect()}
    assert got.keys() == own.keys() and np.allclose([got[i] for i in own], list(own.values()))
    calls.clear()
    S.grid_search(L.LinearRegression, d.drop("fold"), {"learning_rate": [0.01, 0.1], "l2": [0.0, 0.1]}, "neg_rmse", 3)
    assert len(calls) == 1


def test_draws_need_no_quantiles(spark, monkeypatch):
    """The ranges of a draw are known: folds are those of a plain sort, without a pass for cuts."""
    from loomspark.operators import ordering as O
    from loomspark.operators import splits as P

    monkeypatch.setattr(O, "_cuts", lambda *a: 1 / 0)
    d = spark.range(500).selectExpr("id as i", "id % 3 as y")
    drawn = d.withColumn("u", O.draw(42, "i")).collect()
    want = {}
    for y in range(3):
        for n, r in enumerate(sorted((r for r in drawn if r.y == y), key=lambda r: (r.u, r.i))):
            want[r.i] = n % 5
    assert {r.i: r.fold for r in P.stratified_k_fold(d, "i", "y", 5).collect()} == want
    order = [r.i for r in sorted(drawn, key=lambda r: (r.u, r.i))]
    assert {r.i: r.fold for r in P.k_fold(d, "i", 5).collect()} == {i: n // 100 for n, i in enumerate(order)}
    assert {r.i for r in P.train_test_split(d, "i").where("is_test").collect()} == set(order[400:])


def test_images_step_together():
    """Images clustered together come to the centres that each comes to alone, one row at a time."""
    import numpy as np

    from loomspark.operators.vision import _centres

    x = np.random.default_rng(3).integers(0, 256, (7, 21, 3)).astype(float)
    got = _centres(x, 5, 10, 32, 42)
    for image, centres in zip(x, got):
        rng = np.random.default_rng(42)
        c, count = image[rng.permutation(21)[:5]].copy(), np.zeros(5)
        for _ in range(10):
            for row in image[rng.integers(0, 21, 21)]:
                i = int(((c - row) ** 2).sum(1).argmin())
                count[i] += 1
                c[i] += (row - c[i]) / count[i]
        assert (c == centres).all()


def test_nearest_measures_few_pairs_and_loses_none(monkeypatch):
    """Products in single precision leave few pairs to measure, whatever the scale; ties go by id, and rows of one id aren't neighbours."""
    from loomspark.operators.neighbours import Nearest

    r = np.random.default_rng(3)
    for shift, size in ((0, 1), (1e7, 1e-3), (0, 1e-100), (-3, 1e15)):
        x = shift + size * r.integers(-40, 40, (1500, 6)).astype(float)
        x[700:760] = x[5]
        x[9] = shift + size * 1e9
        ids = r.permutation(1500)
        ids[33] = ids[34]
        for alone in (True, False):
            n, measured = Nearest(ids, x, 3, alone), []
            monkeypatch.setattr(n, "_distances", lambda q, t, b, n=n, of=n._distances: measured.append(len(q)) or of(q, t, b))
            for part in np.array_split(np.arange(1500), 4):
                n.meet(ids[part], x[part], ids[part] % 7)
            q, d, near, label = n.found
            assert len(q) == 4500 and (label == near % 7).all() and sum(measured) < 0.03 * 1500 * 1500
            for i in range(0, 1500, 11):
                of = np.sqrt(((x - x[i]) ** 2).sum(1))
                of[(ids == ids[i]) & alone] = np.inf
                o = np.lexsort((ids, of))[:3]
                assert near[q == i].tolist() == ids[o].tolist() and d[q == i].tolist() == of[o].tolist()


def test_knn_of_copies_is_whole(spark):
    """Equal vectors of a block stand for each other as far as k asks; what isn't finite is near nothing."""
    from loomspark.operators import models as L
    from loomspark.operators.neighbours import packed

    rows = [(i, [1.0, 2.0] if i % 2 else [float(i // 100), 0.0], "ab"[i % 2]) for i in range(300)] + [(300, [float("nan"), 0.0], "a")]
    d = spark.createDataFrame(rows, "row_id int, features array<double>, label string")
    blocks = packed(d.select(F.col("row_id").alias("i"), F.col("features").alias("x"), F.col("label").alias("y")), 301, 32, 3).collect()
    assert len(blocks) == 1 and blocks[0].i == [0, 1, 2, 3, 4, 5, 100, 102, 104, 200, 202, 204] and blocks[0].y == list("abababaaaaaa")
    for block in (301, 40):
        near = L.KNearestNeighbors(2, block=block).fit(d).neighbours(d, "row_id", exclude_self=True).orderBy("row_id", "rank").collect()
        assert len(near) == 600
        got = {i: [(r.neighbour, r.distance) for r in near if r.row_id == i] for i in (1, 5, 104, 204)}
        assert got == {1: [(3, 0.0), (5, 0.0)], 5: [(1, 0.0), (3, 0.0)], 104: [(100, 0.0), (102, 0.0)], 204: [(200, 0.0), (202, 0.0)]}


def test_batches_of_queries_keep_documents_in_their_rows(spark, monkeypatch):
    """No join and no shuffle by term or document: tasks leave the k best of each query, ties by key, as joins do for what workers can't hold."""
    from loomspark.operators import retrieval as R

    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(list("abcdefghij"), r.integers(0, 9))) for _ in range(400)]
    d = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "Ä a. A")], "doc_id int, text string").repartition(3)
    q = spark.createDataFrame([("x", "a b, b"), ("y", "j zz"), ("z", "??"), ("w", "ä"), (None, "c")], "item string, text string")
    one = R.bm25_search_many(d, "doc_id", q, "item", 7)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(str, one.collect()))
    monkeypatch.setattr(R, "QUERY_TERMS", 2)
    assert len(got) == 22 and got == sorted(map(str, R.bm25_search_many(d, "doc_id", q, "item", 7).collect()))
    monkeypatch.undo()
    twice = d.unionByName(d.where("doc_id < 3"))  # a key that stands for several rows
    asked = R.bm25_search_many(twice, "doc_id", q, "item", 7)
    assert "Join" in asked._jdf.queryExecution().optimizedPlan().toString() and asked.count() == 22
    assert R.bm25_search_many(d, "doc_id", q.where("item = 'z'"), "item", 7).count() == R.bm25_search_many(d.where("false"), "doc_id", q, "item", 7).count() == 0


def test_best_rows_hold_through_groups_of_rows():
    from loomspark.operators import retrieval as R

    r = np.random.default_rng(6)
    sums = r.integers(0, 40, (300, 4)) / 7 + r.choice([0, 2e-7], (300, 4))
    sums[r.random((300, 4)) < 0.3] = 0
    keys = r.permutation(300)
    best = R.Best(4, 5)
    for part in np.array_split(np.arange(300), 9):
        best.meet(pa.array(keys[part]), sums[part])
    want = [sorted((-round(s, 6), k) for s, k in zip(sums[:, q], keys) if s > 0)[:5] for q in range(4)]
    assert [[(-s, k) for p, s, k in zip(best.found[0], best.found[1], best.found[3]) if p == q] for q in range(4)] == want
    assert R._rounded(np.array([0.5, 1e-7, 2.0000005, 1.2345675])).tolist() == [0.5, 0.0, 2.000001, 1.234568]
    tokens = pa.array([["a", "b", "a"], None, [], ["b"]])
    assert [x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in R.row_counts(tokens)] == [[0, 0, 3], [0, 1, 1], [2, 1, 1], [3, 0, 0, 1], ["a", "b"]]


def test_tfidf_shuffles_words_once(spark):
    """Texts are counted in their rows; what is known to be in the vocabulary isn't summed by document again."""
    from loomspark.operators import retrieval as R

    rows = [(1, "a b, A Ünd"), (2, None), (3, "b ??"), (None, "a 7"), (4, "")]
    d = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    v = R.TfidfVectorizer().fit(d, "doc_id")
    own = v.transform(d, "doc_id")
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
    n, df = 5, {"a": 2, "b": 2, "ünd": 1, "7": 1}
    assert {r.term: r.df for r in v.vocabulary.collect()} == df
    weight = lambda tf, total, t: round(tf / total * (math.log((1 + n) / (1 + df[t])) + 1), 9)
    want = {(1, "a", weight(2, 4, "a")), (1, "b", weight(1, 4, "b")), (1, "ünd", weight(1, 4, "ünd")), (3, "b", weight(1, 1, "b")), (None, "a", weight(1, 2, "a")), (None, "7", weight(1, 2, "7"))}
    rounded = lambda t: [(r.doc_id, r.term, round(r.weight, 9)) for r in t.collect()]
    assert set(rounded(own)) == want and own.count() == 6
    other = spark.createDataFrame([(9, "a zz a b"), (8, "zz")], "doc_id int, text string")  # words that it doesn't know don't count
    assert set(rounded(v.transform(other, "doc_id"))) == {(9, "a", weight(2, 3, "a")), (9, "b", weight(1, 3, "b"))}
    twice = d.unionByName(spark.createDataFrame([(1, "b b")], "doc_id int, text string"))  # two rows of one document
    n, df = 6, df
    w = R.TfidfVectorizer().fit(twice, "doc_id")
    assert {r.term: r.df for r in w.vocabulary.collect()} == df
    assert (1, "b", weight(3, 6, "b")) in rounded(w.transform(twice, "doc_id")) and w.transform(twice, "doc_id").count() == 6


def test_rows_of_folds_are_sent_once(spark, monkeypatch):
    """Models that are fitted on the driver get the rows of all folds from one sending, and the same samples and models as before."""
    from loomspark.operators import models as L
    from loomspark.operators import selection as S

    r = np.random.default_rng(8)
    rows = [(int(i), r.normal(i % 2, 1, 3).tolist(), int(i % 2), [0, 0, 0, 1, 2][i % 5] if i % 50 else None) for i in r.permutation(500)]
    d = spark.createDataFrame(rows, "row_id int, features array<double>, label int, fold int").repartition(3).persist()
    for most in (60, 240, 10_000):
        got = L.driver_samples(d, "row_id", "fold", most)
        assert sorted(got, key=str) == [0, 1, 2, None]
        for f, own in got.items():
            want = L.driver_sample(d if f is None else d.where(F.col("fold") != f), ["features", "label"], "row_id", most)
            assert own.x.tolist() == [list(x) for x in want["features"]] and own.labels == list(want["label"]) and len(own.labels) < 2 * most
        model = L.LogisticRegression(iterations=30, sample=most)
        parts = {f: L.LogisticRegression(iterations=30, sample=most).fit(d.where(F.col("fold") != f)) for f in (0, 1, 2)}
        want = {x.row_id: x.score for f, m in parts.items() for x in m.predict(d.where(F.col("fold") == f)).collect()}
        with monkeypatch.context() as m:
            m.setattr(type(d), "toPandas", lambda self: 1 / 0)
            out = S.out_of_fold(lambda: model.with_params(), d)
            calibrated = S.CalibratedClassifierCV(model, 3).fit(d.drop("fold"))
        assert {x.row_id: x.score for x in out.collect()} == want
        assert calibrated.state["model"] == L.LogisticRegression(iterations=30, sample=most).fit(d).to_dict()
    d.unpersist()
