import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import quality as Q
from loomspark.llm.kernels import string_parts

from .conftest import edge_rows


def corpus(n, seed):
    """Texts and whether they are clean."""
    r = random.Random(seed)
    syllables = ["an", "the", "or", "sta", "ing", "rel", "mo", "ti", "ka", "é", "ß", "lo"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(r.randint(8, 200))]
        sentences = [" ".join(ws[k : k + 9]).capitalize() + "." for k in range(0, len(ws), 9)]
        kind = r.choice(["clean"] * 6 + ["symbols", "shout", "repeat", "table"])
        text = " ".join(sentences)
        if kind == "symbols":
            text = " ".join(w + r.choice(("***", "$$$", "%%%", "###")) for w in ws)
        elif kind == "shout":
            text = " ".join(w.upper() + "!!" for w in ws)
        elif kind == "repeat":
            text = " ".join(w for w in ws[:10] for _ in range(9))
        elif kind == "table":
            text = " | ".join(ws) + " |"
        rows.append((i, text, kind == "clean"))
    return rows


def brute_em(v, count, accusers, rounds):
    """Expectation-maximisation with loops over patterns."""
    m, kinds = v.shape[1], len(accusers)
    start = [[[0.5, 9.5] for _ in range(m)] for _ in range(kinds + 1)]
    for k, j in enumerate(accusers):
        start[k + 1][j] = [9.5, 0.5]
    share = [7.0, *[3.0 / kinds] * kinds]
    prior, table = [x / 10 for x in share], [[[x / 10 for x in t] for t in ts] for ts in start]
    for _ in range(rounds):
        total, new = list(share), [[list(t) for t in ts] for ts in start]
        for row, c in zip(v, count):
            p = [pr * np.prod([ts[j][k // 2] for j, k in enumerate(row) if k != 1]) for pr, ts in zip(prior, table)]
            for y, x in enumerate(p):
                total[y] += x / sum(p) * c
                for j, k in enumerate(row):
                    if k != 1:
                        new[y][j][k // 2] += x / sum(p) * c
        prior = [x / (count.sum() + 10) for x in total]
        table = [[[x / sum(t) for x in t] for t in ts] for ts in new]
    return np.array(prior), np.array(table)


def test_expectation_maximisation_matches_brute_force():
    r = np.random.default_rng(1)
    kind = r.choice(4, 3000, p=[0.6, 0.2, 0.1, 0.1])  # the first are good; the second labeller sees two kinds
    sees = np.array([[0.01, 0.02, 0.005, 0.01, 0.0], [0.9, 0.5, 0.0, 0.05, 0.0], [0.0, 0.8, 0.9, 0.1, 0.0], [0.05, 0.0, 0.05, 0.95, 0.0]])
    v = np.where(r.random((3000, 5)) < sees[kind], 0, np.where(r.random((3000, 5)) < 0.3, 1, 2))
    u, of, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    for rounds in (1, 30):
        model = Q.expectation_maximisation(u, count, (0, 1, 2, 3), rounds)
        prior, table = brute_em(u, count, (0, 1, 2, 3), rounds)
        assert np.abs(model.prior - prior).max() < 1e-9 and np.abs(model.table - table).max() < 1e-9
    model = Q.expectation_maximisation(u, count, (0, 1, 2, 3))
    good = model.posterior(u)[of.ravel()] >= 0.5
    assert abs(model.prior[0] - 0.6) < 0.06 and (good == (kind == 0)).mean() > 0.93 and model.table[0, :4, 0].max() < 0.08


def test_measures_by_hand():
    texts = ["AB cd cd ef! gh| $$ij kl.", "", "a b", "Ä ö é Ñ x"]
    m = Q.measures(*string_parts(pa.array(texts)))
    at = dict(zip(Q.NAMES, m[0]))
    assert at["symbols"] == 2 / 25 and at["upper"] == 2 / 14 and at["repeats"] == 1 / 7
    assert at["bars"] == 1 / 7 and at["shouts"] == 1 / 7 and at["run"] == 7 / 2 and at["marked"] == 0 and at["function"] == 0 and np.isnan(at["sameness"]) and np.isnan(at["balance"])
    assert np.isnan(m[1]).all() and np.isnan(m[2]).all()
    assert m[3][Q.NAMES.index("upper")] == 2 / 5
    m = Q.measures(*string_parts(pa.array(["f(x[1], y) and the rest!! of it**", "((( and five words of it"])))
    at = dict(zip(Q.NAMES, m[0]))
    assert at["balance"] == 1 and at["marked"] == 2 / 9 and at["function"] == 5 / 9 and np.isnan(m[1][Q.NAMES.index("balance")])


def test_held_out_accuracy(documents):
    rows = corpus(1500, 1)
    docs = documents([(i, t) for i, t, _ in rows])
    _, weights = Q.fit(docs)
    fresh = corpus(600, 2)
    z = np.concatenate([Q.score(raw, offsets, weights) for _, _, raw, offsets in Q.pieces(pa.array([t for _, t, _ in fresh]))])
    good = np.array([g for _, _, g in fresh])
    assert ((z >= 0) == good).mean() > 0.97 and (z >= 0)[good].mean() > 0.98
    kept = {x.doc_id for x in Q.classify(docs).collect()}
    assert sum(i in kept for i, _, g in rows if g) > 0.98 * sum(g for _, _, g in rows)
    assert sum(i in kept for i, _, g in rows if not g) < 0.05 * len(rows)


def test_edges(documents):
    out = Q.classify(documents(edge_rows(), extra=True), columns=["doc_id", "text", "lang", "source", "n_chars"])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    ids = [x.doc_id for x in out.collect()]
    assert set(ids) <= {1, None, 4, 5, 6, 7, 8, 9} and {1, 6, 9} <= set(ids) and ids.count(7) == 2 and ids.count(None) == 1
    assert Q.classify(documents([])).collect() == []
    assert len(Q.train([], Q.LabelModel(np.array([0.5, 0.5]), np.full((2, len(Q.LABELLERS), 2), 0.5)))) == (1 << Q.BITS) + 1


def test_code_and_odd_prose_are_kept(documents):
    odd = [
        "import os\nfor name in os.listdir(path):\n    full = os.path.join(path, name)\n    with open(full) as f:\n        data = f.read()\n    print(len(data), data[:10])\n",
        "def f(x):\n    return {k: v[0] for k, v in x.items() if v}\n\nclass A(B):\n    n: int = 3\n\n    def run(self, y):\n        self.n += y * 2\n        return [z for z in range(self.n) if z % 2 == 0]\n",
        "The results (see above) hold for $n > 3$ and for all of the values in [0, 1]; that is what we wanted. It was shown by others before.",
    ]
    rows = [(i, t) for i, t, _ in corpus(1500, 4)] + [(5000 + i, t) for i, t in enumerate(odd)]
    assert {5000, 5001, 5002} <= {x.doc_id for x in Q.classify(documents(rows)).collect()}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/labels.parquet").exists(), reason="no test data")
def test_precision_and_recall_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {x.doc_id for x in Q.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = [(x.doc_id in kept, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    rejected, bad = sum(not k for k, _ in labels), sum(not q for _, q in labels)
    hit = sum(not k and not q for k, q in labels)
    assert hit / rejected > 0.98 and hit / bad > 0.95
