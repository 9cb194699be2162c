import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import topk as T

from .conftest import edge_rows


def brute(docs, queries, k, k1=1.5, b=0.75):
    """Scores every pair."""
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    docs = [(i, words(t)) for i, t, *_ in docs if i is not None and t is not None]
    n, average = len(docs), sum(len(w) for _, w in docs) / max(1, len(docs))
    df = Counter(w for _, ws in docs for w in set(ws))
    out = []
    for q, text in queries:
        times = Counter(words(text or ""))
        scored = []
        for i, ws in docs:
            tf = Counter(ws)
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / average)) for w, m in times.items() if tf[w])
            if s:
                scored.append((round(s, 6), i))
        scored.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return out


def world(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    text = lambda k: " ".join(r.choices(vocabulary, odds, k=k))
    docs = [(i, text(r.randint(1, 80))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # ties
    return docs, [(q, text(r.randint(1, 12))) for q in range(40)]


def check(got, want):
    got = [tuple(x) for x in got]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))


@pytest.mark.parametrize("shard", [50, 100_000])
def test_matches_brute_force(spark, documents, shard, monkeypatch):
    docs, queries = world(600, 12)
    got = T.top_k(documents(docs), spark.createDataFrame(queries, "item_id long, text string"), k=7, shard_docs=shard).orderBy("item_id", "rank").collect()
    check(got, brute(docs, queries, 7))


def test_stops_early_and_on_proof_only():
    r = np.random.default_rng(2)
    n, terms = 20_000, 12
    has = r.random((n, terms)) < np.linspace(0.001, 0.6, terms)
    tf = np.where(has, r.integers(1, 6, (n, terms)), 0)
    first = np.concatenate([[0], np.cumsum(has.sum(1))])
    doc, term = np.nonzero(has)
    df = has.sum(0)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shard = T.Shard(np.arange(n), r.integers(10, 100, n), first, term, tf[doc, term].astype(float), idf, idf.max() * 2.5 / T.LEVELS, 50.0, 1.5, 0.75)
    q, times = np.arange(terms), np.ones(terms, np.int64)
    members, scores = shard.top(q, times, 10, 0.0)
    every = shard.exact(np.arange(n), q, times)
    best = np.lexsort((np.arange(n), -every))[:10]
    assert set(best) <= set(members) and len(members) < n / 4
    assert (scores == every[members]).all()
    assert len(shard.top(q, times, 10, 1e9)[0]) == 0


def test_passes_and_edges(spark, documents):
    docs = edge_rows() + [(50, "ties here"), (51, "ties here")]
    queries = [(1, "same TIES row"), (2, None), (3, ""), (4, "unknownword"), (None, "line nothing"), (6, "same TIES row"), (7, "东京 東京 ünïcödé")]
    q = spark.createDataFrame(queries, "item_id long, text string")
    got = T.top_k(documents(docs, extra=True), q, k=3, queries_per_pass=2).collect()
    check(sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1])), sorted(brute(docs, queries, 3), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
    assert T.top_k(documents([]), q).collect() == []
    assert T.top_k(documents(docs), q.where("false")).collect() == []
