import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm.kernels import string_parts
from loomspark.llm.minhash import components, dart_signatures, keep_one, near_duplicates, signatures, weighted_pairs

from .conftest import edge_rows


def weights(text):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {k: 1 + math.log(n) for k, n in Counter(zip(w, w[1:]) if len(w) > 1 else w).items()}


def jaccard(a, b):
    both = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_weights_match_brute_force():
    texts = ["A b a b a B c", "", "one", "é É two two two two", "x y"]
    pair, weight, first = weighted_pairs(*string_parts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(weight[first[i] : first[i + 1]]) == sorted(weights(t).values())
    assert len(set(pair[first[0] : first[1]])) == len(weights(texts[0]))


def test_agreement_estimates_weighted_jaccard():
    r = random.Random(10)
    k = 4096
    for overlap, scale in ((0.2, 1.0), (0.5, 3.7), (0.9, 0.3)):
        universe = np.array([r.getrandbits(63) for _ in range(120)], np.uint64)
        x = np.array([r.uniform(0.1, 4) * scale for _ in universe])
        y = np.where(np.random.default_rng(1).random(len(x)) < overlap, x, x * 0.2)
        sig = dart_signatures(np.concatenate([universe, universe]), np.concatenate([x, y]), np.array([0, 120, 240]), k)
        true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)


def test_signature_depends_on_the_set_alone():
    e = np.arange(50, dtype=np.uint64) * np.uint64(977)
    w = np.linspace(0.5, 3, 50)
    one = dart_signatures(e, w, np.array([0, 50]), 64)
    two = dart_signatures(np.concatenate([e[:7], e[::-1]]), np.concatenate([w[:7], w[::-1]]), np.array([0, 7, 57, 57]), 64)
    assert (one[0] == two[1]).all() and (two[2] == two[2][0]).all() and (one[0] != two[0]).any()


def test_recall_and_groups(documents):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 7))) for _ in range(800)]
    rows, n = [], 0
    for size in (1,) * 60 + (2,) * 40 + (5,) * 6 + (40,):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 300))]
        for _ in range(size):
            edited = [r.choice(vocabulary) if r.random() < 0.04 else w for w in base]
            rows.append((n, " ".join(edited)))
            n += 1
    found = {x.doc_id: x.duplicate_of for x in near_duplicates(documents(rows)).collect()}
    root = [found.get(i, i) for i in range(n)]
    sets = [weights(t) for _, t in rows]
    pairs = [(i, j, jaccard(sets[i], sets[j])) for i in range(n) for j in range(i)]
    near = [(i, j) for i, j, s in pairs if s >= 0.7]
    assert sum(root[i] == root[j] for i, j in near) >= 0.98 * len(near)
    assert all(root[i] != root[j] for i, j, s in pairs if s < 0.2)
    kept = sorted(x.doc_id for x in keep_one(documents(rows)).collect())
    assert kept == [i for i in range(n) if root[i] == i]


@pytest.mark.parametrize("small", [64, 2])
def test_all_candidates_count(spark, documents, small):
    """Against the components of all pairs that share a band and agree enough, compared one by one."""
    r = random.Random(15)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):  # many pairs near the threshold, which the first comparisons miss
        base = rows[r.randrange(len(rows))][1].split() if i > 20 else [r.choice(vocabulary) for _ in range(40)]
        rows.append((i, " ".join(r.choice(vocabulary) if r.random() < 0.12 else w for w in base)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    k, bands, threshold = 64, 32, 0.5
    sig = {x.doc_id: np.frombuffer(x.sig, np.uint32) for x in signatures(documents(rows), k).collect()}
    root = {i: i for i in sig}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sig:
        for j in sig:
            same = sig[i] == sig[j]
            if i < j and same.reshape(bands, -1).all(1).any() and same.mean() >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in sig if find(i) != i}
    assert {x.doc_id: x.duplicate_of for x in near_duplicates(documents(rows), k, bands, threshold, small).collect()} == want and len(set(want.values())) > 3


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {103: 100, 101: 100}


def test_edges(documents):
    rows = edge_rows() + [(40, "word"), (41, "Word!"), (7, "another text of the same id")]
    docs = documents(rows, extra=True)
    assert {(x.doc_id, x.duplicate_of) for x in near_duplicates(docs).collect()} >= {(40, 8), (41, 8)}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [(x.doc_id, x.text) for x in kept.collect()]
    assert ids.count((7, "another text of the same id")) == 1 and ids.count((7, "same row")) == 1
    assert (None, None) in ids and (2, None) in ids and (3, "") in ids and (40, "word") not in ids
    assert near_duplicates(documents([])).collect() == [] and keep_one(documents([])).collect() == []
