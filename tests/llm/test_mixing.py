import random
from fractions import Fraction

from loomspark.llm.mixing import mix_sources, quotas

from .conftest import edge_rows


def brute(available, weights, budget):
    """One seat at a time."""
    got = dict.fromkeys(available, 0)
    for _ in range(int(sum(available.values()) * budget)):
        open_ = [s for s in available if got[s] < available[s] and weights.get(s, 0) > 0]
        if not open_:
            break
        best = min(open_, key=lambda s: (-Fraction(weights[s]) / (2 * got[s] + 1), s))
        got[best] += 1
    return {s: n for s, n in got.items() if n}


def test_quotas_match_brute_force(spark):
    r = random.Random(6)
    weights = {"a": 8.0, "b": 4.0, "c": 4.0, "d": 0.5, "e": 0.0}
    supply = {s: {x: r.randint(1, 30) for x in "abcdef"} for s in range(8)}
    rows = [(s, x, n) for s, have in supply.items() for x, n in have.items()]
    got = quotas(spark.createDataFrame(rows, "shard int, src string, available int"), spark.createDataFrame(list(weights.items()), "src string, weight double"), 0.5).collect()
    for s, have in supply.items():
        assert {x.src: x.quota for x in got if x.shard == s} == brute(have, weights, 0.5)


def test_shares_come_near_the_targets(documents):
    r = random.Random(7)
    docs = documents([(i, "x" * r.randint(40, 400), r.choice("aaaaaabc")) for i in range(4000)])
    out = mix_sources(docs, {"a": 1.0, "b": 1.0, "c": 2.0}, block=500, tokens_per_shard=50_000, budget=0.25).collect()
    tokens = {s: sum(x.n_tokens for x in out if x.source == s) for s in "abc"}
    total = sum(tokens.values())
    assert abs(tokens["a"] / total - 0.25) < 0.04 and abs(tokens["c"] / total - 0.5) < 0.06
    assert len({x.shard for x in out}) > 2 and len({x.doc_id for x in out}) == len(out)


def test_edges(documents):
    docs = documents(edge_rows(), extra=True)
    out = mix_sources(docs, budget=1.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "block", "n_tokens"]
    ids = [x.doc_id for x in out.collect()]
    assert sorted(ids, key=str) == sorted([1, None, 4, 5, 6, 7, 7, 8, 9], key=str)
    assert mix_sources(docs, {"s": 0.0}).collect() == []
    # a shard of one block gives it, and repeated rows go together
    assert [x.doc_id for x in mix_sources(documents([(1, "one small text")])).collect()] == [1]
    many = documents([(i, "x" * 300) for i in range(100) for _ in range(2)])
    taken = [x.doc_id for x in mix_sources(many, block=500, budget=0.3).collect()]
    assert 0 < len(set(taken)) < 100 and all(taken.count(i) == 2 for i in set(taken))
    long = mix_sources(documents([(1, "x" * 2_000_000), (2, "y" * 100)]), block=500, budget=1.0).collect()
    assert {x.doc_id for x in long} == {1, 2}
    assert mix_sources(documents([])).collect() == []
