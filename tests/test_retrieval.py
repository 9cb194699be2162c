import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import explorer as X
from loomspark.operators import retrieval as R
from loomspark.streaming import events as E


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25(spark):
    d = docs(spark, ["machine learning in php", "football match analysis", None])
    got = R.bm25_search(d, "doc_id", "php machine", 3).collect()
    assert got[0].doc_id == 0 and got[0].score > 0 and [x.score for x in got[1:]] == [0, 0]
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 12))) for _ in range(60)]
    q = "a b a z"
    lens = [len(t.split()) for t in texts]
    avg = sum(lens) / len(lens)

    def score(t, n):
        total = 0.0
        for w in q.split():
            df = sum(w in x.split() for x in texts)
            tf = t.split().count(w)
            total += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
        return total

    want = sorted(((-round(score(t, n), 9), i) for i, (t, n) in enumerate(zip(texts, lens))))[:10]
    assert [(-round(x.score, 9), x.doc_id) for x in R.bm25_search(docs(spark, texts), "doc_id", q, 10).collect()] == want
    many = R.bm25_search_many(docs(spark, texts), "doc_id", spark.createDataFrame([(7, q)], "q int, text string"), "q", 5).orderBy("rank").collect()
    assert [x.score for x in many] == [round(-s, 6) for s, _ in want[:5]]


def test_vectorizers(spark):
    d = docs(spark, ["machine learning in php", "php library for machine intelligence", "learning systems and intelligence"])
    v = R.TfidfVectorizer().fit(d, "doc_id")
    assert v.vocabulary.count() == 9
    w = {(x.doc_id, x.term): x.weight for x in v.transform(d, "doc_id").collect()}
    assert abs(w[0, "php"] - (math.log(4 / 3) + 1) / 4) < 1e-12
    import zlib

    got = {x["index"]: x.value for x in R.hashing_vectorize(docs(spark, ["one two one"]), "doc_id").collect()}
    want: dict = {}
    for t in ("one", "two", "one"):
        h = zlib.crc32(t.encode())
        want[h % 1024] = want.get(h % 1024, 0) + (-1 if h >> 31 & 1 else 1)
    size = math.sqrt(sum(x * x for x in want.values()))
    assert got == pytest.approx({k: x / size for k, x in want.items()})
    e = R.hash_embed(docs(spark, ["a b", ""]), "doc_id").orderBy("doc_id").collect()
    assert abs(sum(x * x for x in e[0].vector) - 1) < 1e-9 and set(e[1].vector) == {0.0} and len(e[0].vector) == 32


def test_chunks(spark):
    d = docs(spark, ["one two three four five six seven eight", "short", "  ", None])
    got = R.chunk_words(d, "doc_id", size=3, overlap=1).where("doc_id = 0").orderBy("chunk").collect()
    assert [x.text for x in got] == ["one two three", "three four five", "five six seven", "seven eight"]
    r = random.Random(5)
    for _ in range(6):
        n, size = r.randint(1, 20), r.randint(1, 6)
        overlap = r.randint(0, size)
        words = [str(i) for i in range(n)]
        step, want = max(1, size - max(0, min(overlap, size - 1))), []
        for i in range(0, n, step):
            want.append(" ".join(words[i : i + size]))
            if len(words[i : i + size]) < size:
                break
        assert [x.text for x in R.chunk_words(docs(spark, [" ".join(words)]), "doc_id", size=size, overlap=overlap).orderBy("chunk").collect()] == want
    cut = R.split_text(docs(spark, ["hello world this is a long enough sentence for chunking tests"]), "doc_id", size=40, overlap=10).orderBy("chunk").collect()
    assert [x.start for x in cut] == [0, 30, 60] and cut[0].id == "0#chunk-0"
    assert R.split_text(d, "doc_id").where("doc_id >= 2").count() == 0


def test_dense_hybrid_rerank(spark):
    items = spark.createDataFrame([("x", [0.1, 0.2], "hello", {"m": "1"}), ("y", [0.2, 0.1], "php search", {"m": "2"})], "id string, vector array<double>, text string, metadata map<string,string>")
    assert R.cosine_search(items, [0.1, 0.2], 1).first().id == "x" and R.cosine_search(items, [0.1, 0.2], 5, {"m": "2"}).first().id == "y"
    assert R.hybrid_search(items, "php search", [0.1, 0.2], 1).first().id == "y"
    assert R.rerank_lexical(items.withColumn("score", F.lit(0.0)), "hello").where("id = 'x'").first().score == pytest.approx(0.3)
    assert R.expand_query("q") == ["q", "q explanation", "about q"] and R.verify_grounding(" ", []) == ["empty answer", "no contexts", "no context scores above zero"]
    stub = R.remote_embed(items, lambda ts: [[float(len(t)), 1.0] for t in ts]).orderBy("id").collect()
    assert [x.vector for x in stub] == [[5.0, 1.0], [10.0, 1.0]]


def test_qa_chain(spark):
    d = spark.createDataFrame([("d1", "refund policy needs a receipt"), ("d2", "football match")], "doc_id string, text string")
    embed = lambda c: R.hash_embed(c, "id").join(c, "id")
    one = lambda q: R.hash_embed(spark.createDataFrame([("q", q)], "id string, text string"), "id").first().vector
    out = R.QaChain(embed, one, expand=R.expand_query).index(d, "doc_id").ask("refund policy needs a receipt", 1)
    assert out["citations"] == ["d1#chunk-0"] and out["verification"]["is_valid"] and out["diagnostics"]["query_count"] == 3
    assert "".join(R.stream(out["answer"])) == out["answer"]


@pytest.fixture
def explorer(spark):
    e = X.Explorer(spark)
    e.add_text("d1", "Refund policy with receipt applies in January only.", source="notes", tag="policy", date="2026-01-12")
    return e.add_text("d2", "Shipping delays in February for external vendors.", source="ops", tag="ops", date="2026-02-10")


def test_structured_query(spark, explorer):
    q = 'tag:policy source:notes "refund policy" AND receipt NOT shipping date:2026-01..2026-01'
    p = X.parse_query(q)
    assert (p.phrases, p.must, p.must_not, p.strict) == (["refund policy"], ["receipt"], ["shipping"], True)
    assert [x.doc_id for x in explorer.search(q).collect()] == ["d1"] and explorer.search(q.replace("2026-01..2026-01", "2026-02..2026-03")).collect() == []
    assert explorer.fetch("d1", 0, 12).first().text == "Refund polic" and explorer.stats().first().documents == 2
    e = X.Explorer(spark).add_text("d", "Refund policy allows refunds within 30 days with receipt.")
    assert e.search('near(refund, "30 days", window=45)').count() == 1 and e.search('near(policy, "receipt", window=2)').count() == 0


def test_near_matches_brute_force(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abx ") for _ in range(r.randint(0, 40))) for _ in range(120)]
    a, b, w = "ab", "x a", 4

    def at(s, t):
        return [m.start() for m in re.finditer(f"(?={re.escape(s)})", t)]

    want = [i for i, t in enumerate(texts) if any(abs(p - q) <= round(w * 1.8) for p in at(a, t) for q in at(b, t))]
    assert [x.doc_id for x in docs(spark, texts).where(X.near(F.col("text"), a, b, w)).orderBy("doc_id").collect()] == want


def test_explorer_answers(spark, explorer, tmp_path):
    assert explorer.query("glossary please")["answer"].startswith("Glossary: ") and explorer.query("")["intent"] == "NONE"
    assert explorer.query("summarize refund receipt")["citations"][0]["doc_id"] == "d1"
    assert explorer.query("refund")["citations"][0]["doc_id"] == "d1"
    parts = X.split_questions("where is Lusaka? how much is bread there and when do shops open there?")
    assert parts == ["where is Lusaka", "how much is bread there", "when do shops open there"]
    state: dict = {}
    X.remember(parts[0], state)
    assert X.resolve_references(parts[1], state) == "how much is bread in Lusaka"
    assert explorer.query_multi("what is the price of bread?")["parts"][0]["answer"] == "Not found in local corpus."
    explorer.save(f"{tmp_path}/i")
    again = X.Explorer.load(spark, f"{tmp_path}/i")
    assert again.search("refund").first().doc_id == "d1"
    explorer.remove("d1")
    assert {x.doc_id for x in explorer.chunks.collect()} == {"d2"}
    assert explorer.regex(r"[A-Z]\w+", 1).first().match == "Shipping"


def test_streams(spark, tmp_path):
    docs(spark, ["a b a", "b"]).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    E.index_stream(src, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert {tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()} == {(0, 3, "a", 2), (0, 3, "b", 1), (1, 1, "b", 1)}
    out = E.stream_answers(docs(spark, ["x" * 90]), lambda t: t, "doc_id").collect()
    assert [len(x.piece) for x in out] == [40, 40, 10]
