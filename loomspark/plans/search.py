"""Queries: vectorizers, BM25, dense and hybrid search, chunks and the document explorer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import explorer as X
from ..operators import retrieval as R
from .tabular import r6, read
from .texts import ORACLE_SQL as _TEXTS
from .texts import WORDS, q

SENTENCES = _TEXTS["sentence_split"]
QUERY = "the heating of the under einer"
STRUCTURED = '"of the" this NOT einer OR er OR und source:src3'


def _docs(spark, sf):
    return read(spark, sf, "documents")


def bm25_search(spark, sf):
    return R.bm25_search(_docs(spark, sf), "doc_id", QUERY, 10).select("doc_id", r6("score").alias("score"))


def bm25_all_benchmarks(spark, sf):
    """Every benchmark item as a query."""
    return R.bm25_search_many(_docs(spark, sf), "doc_id", read(spark, sf, "benchmark"), "item_id", 5)


def tfidf_weights(spark, sf):
    d = _docs(spark, sf)
    return R.TfidfVectorizer().fit(d, "doc_id").transform(d, "doc_id").select("doc_id", "term", r6("weight").alias("weight"))


def idf_vocabulary(spark, sf):
    return R.TfidfVectorizer().fit(_docs(spark, sf), "doc_id").vocabulary.select("term", "df", r6("idf").alias("idf"))


def hash_vectorize(spark, sf):
    return R.hashing_vectorize(_docs(spark, sf), "doc_id").select("doc_id", "index", r6("value").alias("value"))


def hash_embed(spark, sf):
    return R.hash_embed(_docs(spark, sf), "doc_id").select("doc_id", F.posexplode("vector").alias("i", "x")).select("doc_id", "i", r6("x").alias("x"))


def chunk_words(spark, sf):
    return R.chunk_words(_docs(spark, sf), "doc_id").select("doc_id", "chunk", F.md5("text").alias("digest"))


def chunk_chars(spark, sf):
    return R.split_text(_docs(spark, sf), "doc_id").select("doc_id", "id", "start", F.md5("text").alias("digest"))


def _items(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label"))
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return e.join(d, "id")


_V = [((7 * i) % 13 - 6) / 10 for i in range(64)]


def cosine_topk(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return R.cosine_search(e, _V, 10).select("id", r6("score").alias("score"))


def cosine_filtered(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return R.cosine_search(e, _V, 10, {"label": 2}).select("id", r6("score").alias("score"))


def hybrid_topk(spark, sf):
    return R.hybrid_search(_items(spark, sf), QUERY, _V, 5).select("id", r6("dense_score").alias("dense_score"), r6("lexical_score").alias("lexical_score"), r6("score").alias("score"))


def rerank_lexical(spark, sf):
    scored = _docs(spark, sf).select("doc_id", "text", ((F.col("n_chars") % 100) / 100).alias("score"))
    return R.rerank_lexical(scored, QUERY).select("doc_id", r6("lexical_overlap").alias("lexical_overlap"), r6("score").alias("score"))


def _explorer(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", "source", F.col("lang").alias("tag"))
    return X.Explorer(spark).add(d)


def explorer_chunks(spark, sf):
    return _explorer(spark, sf).chunks.select("doc_id", "chunk", "start", "end", F.md5("text").alias("digest"))


def explorer_constraints(spark, sf):
    """Every chunk against the structured query's filters, constraints and boosts."""
    p = X.parse_query(STRUCTURED)
    c = _explorer(spark, sf).chunks.where(X.matches(p.filters) & X.constraint(p))
    return c.select("doc_id", "chunk", r6(X.boost(p)).alias("boost"))


def explorer_near(spark, sf):
    c = _explorer(spark, sf).chunks
    return c.where(X.near(F.col("text"), "with", "the", 5)).select("doc_id", "chunk")


def explorer_search(spark, sf):
    return _explorer(spark, sf).search(STRUCTURED, 10).select("doc_id", "chunk", r6("score").alias("score"))


def explorer_summary(spark, sf):
    s = X.sentence_scores(_docs(spark, sf), QUERY, ["doc_id"])
    return s.select("doc_id", "nth", r6("score").alias("score"))


def regex_extract(spark, sf):
    d = X.regex_matches(_docs(spark, sf), "doc_id", r"\b[a-z]+ing\b")
    wrong = F.count_if(F.col("end") - F.col("start") != F.length("match"))
    return d.groupBy("match").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), wrong.alias("wrong"))


def explorer_fetch(spark, sf):
    """Characters 10 to 40 of one document, and all of another, by id."""
    e = _explorer(spark, sf)
    return e.fetch("7", 10, 40).unionByName(e.fetch("8"))


def explorer_date_filter(spark, sf):
    """Chunks of documents dated within a quarter; documents get a month by their id."""
    d = _docs(spark, sf).select("doc_id", "text", "source", F.col("lang").alias("tag"), F.concat(F.lit("2026-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-15")).alias("date"))
    p = X.parse_query("the date:2026-02..2026-04 tag:en")
    return X.Explorer(spark).add(d).chunks.where(X.matches(p.filters)).select("doc_id", "chunk")


def similarity_floor(spark, sf):
    """Grounding: the checks that a benchmark item fails as an answer with the score of its length."""
    b = read(spark, sf, "benchmark")

    @F.pandas_udf("string")
    def issues(text: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series([",".join(R.verify_grounding(t or "", [s])) for t, s in zip(text, score)])

    return b.select("item_id", issues(F.col("text"), (F.length("text") % 3).cast("double")).alias("issues"))


def prompt_intents(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", X.intent("text").alias("intent"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_all_benchmarks, tfidf_weights, idf_vocabulary, hash_vectorize, hash_embed, chunk_words, chunk_chars, cosine_topk, cosine_filtered, hybrid_topk, rerank_lexical, explorer_chunks, explorer_constraints, explorer_near, explorer_search, explorer_summary, explorer_fetch, explorer_date_filter, similarity_floor, regex_extract, prompt_intents)}

_T = q(R.TERM)
_TF = f"tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(text), {_T})) term from documents) group by all)"
_Q = R.ascii_terms(QUERY)
_QS = ", ".join(f"('{t}')" for t in _Q)
_QLIST = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(_Q)) + "]"
_QWORDS = "[" + ", ".join(q(t) for t in dict.fromkeys(QUERY.lower().split())) + "]"
_VEC = "cast([" + ", ".join(map(str, _V)) + "] as double[])"
_CHUNKS = """ch0 as (select doc_id, source, lang as tag, text t, unnest(range(0, length(text), 370)) st from documents where trim(text) <> ''),
    ch1 as (select cast(doc_id as varchar) as doc_id, source, st, st // 370 as chunk, substr(t, cast(st + 1 as bigint), 450) as text from ch0), ch as (select * from ch1 where trim(text) <> '')"""
_LEX = " + ".join(f"len([x for x in ws if x = '{t}']) * 2.5 / (len([x for x in ws if x = '{t}']) + 1.5 * (0.25 + 0.75 * len(ws) / 100.0::double))" for t in _Q)
_P = X.parse_query(STRUCTURED)


def _constraints() -> str:
    has = lambda t: f"contains(lower(text), {q(t)})"
    out = [has(t) for t in (*_P.phrases, *_P.must)] + [f"not {has(t)}" for t in _P.must_not] + ([f"({' or '.join(has(t) for t in _P.should)})"] if _P.should else [])
    return " and ".join([*out, f"source = {q(_P.filters['source'])}"])


def _boosts() -> str:
    out = [f"case when contains(lower(text), {q(t)}) then {by} else 0 end" for ts, by in ((_P.phrases, 0.2), (_P.must, 0.05), (_P.should, 0.03)) for t in ts]
    return "cast(" + " + ".join(out) + " as double)"


_STERMS = ", ".join(f"('{t}')" for t in R.re.findall(r"[^\W_]+", _P.search_query))


def _bm25(table: str, key: str, terms: str) -> str:
    return f"""w as (select {key}, regexp_extract_all(lower(text), {_T}) ws from {table}), n as (select count(*) n, avg(len(ws)) a from w), qt(t) as (values {terms}),
        f as (select t, count(*) times, (select count(*) from w where list_contains(ws, t)) df from qt group by t),
        sc as (select {key}, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / a))) score from (select {key}, ws, t, times, df, len(list_filter(ws, lambda x: x = t)) tf from w, f) , n group by {key})"""


ORACLE_SQL = {
    "bm25_search": f"with {_bm25('documents', 'doc_id', _QS)} select doc_id, round(score, 6) as score from sc order by score desc, doc_id limit 10",
    "bm25_all_benchmarks": f"""with {_TF}, l as (select doc_id, len(regexp_extract_all(lower(text), {_T})) dl from documents), n as (select count(*) n, avg(dl) a from l),
        qs as (select item_id, term, count(*) times from (select item_id, unnest(regexp_extract_all(lower(text), {_T})) term from benchmark) group by all), h as (select * from tf where term in (select term from qs)),
        d as (select term, count(*) df from h group by term), s as (select item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) as score from h join d using (term) join l using (doc_id) join qs using (term), n group by all)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s qualify row_number() over (partition by item_id order by score desc, doc_id) <= 5""",
    "tfidf_weights": f"""with {_TF}, d as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))::double) + 1 idf from tf group by term)
        select doc_id, term, round(tf / sum(tf) over (partition by doc_id)::double * idf, 6) as weight from tf join d using (term)""",
    "idf_vocabulary": f"with {_TF} select term, count(*) as df, round(ln((1 + (select count(*) from documents)) / (1 + count(*))::double) + 1, 6) as idf from tf group by term",
    "hash_embed": r"""with t as (select doc_id, md5(w) m from (select doc_id, unnest(regexp_extract_all(text, '\S+')) w from documents)), s as (select doc_id, i, sum(cast('0x' || substr(m, cast(2 * i + 1 as bigint), 2) as bigint) / 255.0::double) x from t, range(16) r(i) group by doc_id, i),
        f as (select doc_id, r.i, coalesce(s.x, 0) x from documents cross join range(32) r(i) left join s using (doc_id) where s.i is null or s.i = r.i % 16)
        select doc_id, cast(i as int) as i, round(x / greatest(1e-12, sqrt(sum(x * x) over (partition by doc_id))), 6) as x from f""",
    "chunk_words": r"""with w as (select doc_id, string_split_regex(trim(text), '\s+') w from documents), c as (select doc_id, w, unnest(range(0, len(w), 100)) st from w), k as (select *, st // 100 chunk, max(case when st + 120 <= len(w) then st // 100 else -1 end) over (partition by doc_id) fullest from c)
        select doc_id, cast(chunk as int) as chunk, md5(array_to_string(w[cast(st + 1 as bigint) : cast(st + 120 as bigint)], ' ')) as digest from k where chunk <= fullest + 1""",
    "chunk_chars": """with d as (select doc_id, trim(text) t from documents where trim(text) <> ''), c as (select doc_id, t, unnest(range(0, length(t), 680)) st from d)
        select doc_id, doc_id || '#chunk-' || (st // 680) as id, cast(st as int) as start, md5(substr(t, cast(st + 1 as bigint), 800)) as digest from c""",
    "cosine_topk": f"select vec_id as id, round(list_cosine_similarity(cast(embedding as double[]), {_VEC}), 6) as score from embeddings order by list_cosine_similarity(cast(embedding as double[]), {_VEC}) desc, id limit 10",
    "cosine_filtered": f"select vec_id as id, round(list_cosine_similarity(cast(embedding as double[]), {_VEC}), 6) as score from embeddings where label = 2 order by list_cosine_similarity(cast(embedding as double[]), {_VEC}) desc, id limit 10",
    "hybrid_topk": f"""with c as (select vec_id as id, list_cosine_similarity(cast(embedding as double[]), {_VEC}) ds, regexp_extract_all(lower(text), '[a-z0-9]+') ws from embeddings join documents on vec_id = doc_id order by ds desc, id limit 15), l as (select id, ds, {_LEX} ls from c)
        select id, round(ds, 6) as dense_score, round(ls, 6) as lexical_score, round(0.7 * ds + 0.3 * ls, 6) as score from l order by 0.7 * ds + 0.3 * ls desc, ds desc, id limit 5""",
    "rerank_lexical": f"""with w as (select doc_id, (n_chars % 100) / 100.0::double s, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ws from documents), j as (select doc_id, s, len(list_intersect(ws, {_QLIST})) / len(list_distinct(list_concat(ws, {_QLIST})))::double o from w)
        select doc_id, round(o, 6) as lexical_overlap, round(0.7::double * s + 0.3::double * o, 6) as score from j""",
    "explorer_chunks": f"with {_CHUNKS} select doc_id, cast(chunk as int) as chunk, cast(st as int) as start, cast(st + length(text) as int) as end, md5(text) as digest from ch",
    "explorer_constraints": f"with {_CHUNKS} select doc_id, cast(chunk as int) as chunk, round({_boosts()}, 6) as boost from ch where {_constraints()}",
    "explorer_near": f"""with {_CHUNKS} select doc_id, cast(chunk as int) as chunk from ch where regexp_matches(lower(text), '(?s)withe|with.{{0,5}}the|the.{{0,6}}with')""",
    "explorer_search": f"""with {_CHUNKS}, {_bm25("(select doc_id || '#' || chunk as ck, text from ch)", 'ck', _STERMS)}, t as (select ch.doc_id, ch.chunk, ch.text, ch.source, score from sc join ch on ck = ch.doc_id || '#' || ch.chunk order by score desc, ch.doc_id, ch.chunk limit 100)
        select doc_id, cast(chunk as int) as chunk, round(score + {_boosts()}, 6) as score from t where {_constraints()} order by score + {_boosts()} desc, doc_id, chunk limit 10""",
    "regex_extract": r"""select m as match, count(*) as n, min(doc_id) as first_doc, cast(0 as bigint) as wrong from (select doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_\p{M}])([a-z]+ing)\b', 1)) m from documents) group by m""",
    "explorer_fetch": "select cast(doc_id as varchar) as doc_id, case doc_id when 7 then substr(text, 11, 30) else text end as text from documents where doc_id in (7, 8)",
    "explorer_date_filter": f"""with {_CHUNKS} select doc_id, cast(chunk as int) as chunk from ch where (cast(doc_id as bigint) % 12) between 1 and 3 and cast(doc_id as bigint) in (select doc_id from documents where lang = 'en')""",
    "similarity_floor": "select item_id, case when length(text) % 3 = 0 then 'no context scores above zero' else '' end as issues from benchmark",
    "explorer_summary": f"""with s as ({SENTENCES}) select doc_id, nth, round(len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), {WORDS})), {_QWORDS})) / len({_QWORDS})::double, 6) as score from s""",
    "prompt_intents": """select conv_id, turn, case when contains(lower(text), 'countries mentioned') then 'ENTITY_COUNTRY' when contains(lower(text), 'glossary') then 'GLOSSARY' when contains(lower(text), 'summarize') or contains(lower(text), 'summary') then 'SUMMARY' else 'SEARCH' end as intent from conversations""",
}
