import random

import corpus_pipeline
from loomspark.llm import queries
from loomspark.llm.packing import Packer, pack
from loomspark.llm.token_counts import PATTERN, RANKS, tokenizer

from .conftest import edge_rows


def brute(sizes, capacity, open_bins):
    """A list of open bins in order of their last change of free space."""
    bins, out, n = [], [], 0  # [free, age of that free space, id]
    for age, size in enumerate(sizes):
        fit = [b for b in bins if b[0] >= size]
        if fit:
            b = min(fit, key=lambda b: (b[0], b[1]))
        else:
            if size < capacity and len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: (b[0], b[1])))
            b = [capacity, 0, n]
            n += 1
            bins.append(b)
        out.append((b[2], capacity - b[0]))
        b[0], b[1] = b[0] - size, age
        if b[0] == 0:
            bins.remove(b)
    return out


def test_placement_matches_brute_force():
    r = random.Random(3)
    for capacity, open_bins in ((10, 1), (10, 3), (64, 8), (7, 100)):
        sizes = [r.randint(1, capacity) for _ in range(2000)]
        packer = Packer(capacity, open_bins)
        assert [packer.place(n) for n in sizes] == brute(sizes, capacity, open_bins)


def test_no_bin_overflows_and_no_token_is_lost(documents):
    r = random.Random(4)
    docs = documents([(i, "x" * r.randint(1, 900)) for i in range(500)])
    rows = pack(docs, capacity=100, open_bins=5, docs_per_shard=120).collect()
    assert {r.shard for r in rows} == set(range(5))
    bins, by_doc = {}, {}
    for x in rows:
        bins.setdefault((x.shard, x.bin), []).append((x.bin_offset, x.n_tokens))
        by_doc.setdefault(x.doc_id, []).append((x.piece, x.start, x.n_tokens))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 100
    want = {d.doc_id: -(-len(d.text) // 4) for d in docs.collect()}
    for doc, parts in by_doc.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(parts)):
            assert piece == k and start == at
            at += n
        assert at == want[doc]
    assert by_doc.keys() == want.keys()


def test_edges(documents):
    rows = pack(documents(edge_rows(), extra=True), capacity=50).collect()
    ids = [r.doc_id for r in rows]
    assert 2 not in ids and 3 not in ids and None in ids and ids.count(7) == 2
    assert pack(documents([])).collect() == []
    given = pack(documents([(1, "abc"), (2, None)]).selectExpr("*", "7 as t"), token_col="t", capacity=5).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in given) == [(1, 2), (1, 5), (2, 2), (2, 5)]


def test_query_and_last_stage_count_tokens(spark, documents, tmp_path):
    texts = ["Die Straßenbahnhaltestellenüberdachung wurde großzügig erneuert. " * 300, "def f(x):\n    return {k: v[0] for k, v in x.items() if v}\n" * 200, "The cat sat on the mat. " * 400, "東京 😀 " * 90, "a", "", None]
    docs = documents([*enumerate(texts), (None, "no id"), (4, "a")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    encode = tokenizer(RANKS, PATTERN)[0].encode_ordinary
    want = {i: len(encode(t)) for i, t in enumerate(texts) if t} | {None: len(encode("no id")), 4: 2}
    assert any(n != -(-len(texts[i].encode()) // 4) for i, n in want.items() if i in (0, 1, 2))
    for rows in (queries.op1_best_fit_packing(spark, str(tmp_path)).collect(), corpus_pipeline.best_fit(spark, docs, str(tmp_path)).collect()):
        got, bins = {}, {}
        for x in rows:
            got[x.doc_id] = got.get(x.doc_id, 0) + x.n_tokens
            bins[x.shard, x.bin] = bins.get((x.shard, x.bin), 0) + x.n_tokens
        assert got == want and max(bins.values()) <= 2048
    # the whole result: pieces in order of id and length, placed one by one in their shard; spans of pieces give back the texts
    rows = sorted(queries.op1_best_fit_packing(spark, str(tmp_path)).collect(), key=lambda x: (x.doc_id is not None, x.doc_id, x.piece))
    ids = sorted([(-1 if i is None else i, n) for i, n in want.items() if i != 4] + [(4, 1), (4, 1)])
    sizes = [(i, k, s, min(2048, n - s)) for i, n in ids for k, s in enumerate(range(0, n, 2048))]
    placed = brute([x[3] for x in sizes], 2048, 64)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.piece, x.start, x.n_tokens, x.bin, x.bin_offset) for x in rows) == sorted((*s, *p) for s, p in zip(sizes, placed))
    decode = tokenizer(RANKS, PATTERN)[0].decode
    for i, text in enumerate(texts[:4]):
        assert "".join(decode(encode(text)[x.start : x.start + x.n_tokens]) for x in rows if x.doc_id == i) == text or "\ufffd" in "".join(decode(encode(text)[x.start : x.start + x.n_tokens]) for x in rows if x.doc_id == i)
