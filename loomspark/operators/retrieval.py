"""Vectorizers, BM25, dense and hybrid search, chunking and question answering over DataFrames.

A query is a string on the driver and compiles to a projection over the corpus with a bounded top-k: no join and no shuffle but
for the k best rows. Batches of queries are tables and go through postings joins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions import vectors as V
from ..workers import by_slices, ready, release

TERM = r"[\p{L}\p{N}]+"
ASCII_TERM = "[a-z0-9]+"
_PIECE = re.compile(r"\S+", re.ASCII)


def term_counts(docs: DataFrame, key: str, text: str = "text", pattern: str = TERM) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(T.lower_words(text, pattern)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


QUERY_TERMS = 1_000_000  # of a batch of queries that workers hold
TOKENS, SUMS, ROWS = 1 << 20, 1 << 20, 1 << 16  # words, and sums of documents and queries, that a worker looks at together; rows that leave it together


def row_counts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, codes of the distinct words in each and how often they occur there; the lengths of all rows; the words of the codes."""
    length = pa.compute.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    size = max(1, len(coded.dictionary))
    pair = np.sort(np.repeat(np.arange(len(tokens)) * size, length) + coded.indices.to_numpy())
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    row, code = np.divmod(pair[first], size)
    return row, code, np.diff(first, append=len(pair)), length, coded.dictionary


def short(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Keys and lists of words of rows that have few words together; a longer row comes alone."""
    keys, tokens = batch.columns[:2]
    end = np.cumsum(pa.compute.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(end, (end[first - 1] if first else 0) + TOKENS, "right")))
        yield keys[first:last], tokens[first:last]
        first = last


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To six places, as Spark's round: half up, on the shortest decimal."""
    values, at = np.unique(scores, return_inverse=True)
    return np.array([float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in values.tolist()])[at]


class Best:
    """The k rows of best rounded score of each query, ties by key, of the rows seen so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.bar = k, np.full(queries, -np.inf)
        self.found: tuple[np.ndarray, ...] | None = None  # query, rounded score, score, key

    def meet(self, keys: pa.Array, sums: np.ndarray) -> None:
        """sums: a row for each key, a column for each query; 0 where they share nothing."""
        if len(sums) >= self.k:  # what is rounded to the k-th score is within half a millionth of it
            self.bar = np.maximum(self.bar, np.partition(sums, -self.k, 0)[-self.k] - 2e-6)
        row, q = np.nonzero((sums > 0) & (sums >= self.bar))
        if not len(row):
            return
        s = sums[row, q]
        new = (q, _rounded(s), s, np.array(keys.take(pa.array(row)).to_pylist()))
        q, r, s, own = (np.concatenate(c) for c in zip(*([self.found] if self.found else []), new))
        order = np.lexsort((own, -r, q))
        q = q[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        at = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        order, q, at = order[at < self.k], q[at < self.k], at[at < self.k]
        self.found = q, r[order], s[order], own[order]
        full = at == self.k - 1
        self.bar[q[full]] = np.maximum(self.bar[q[full]], self.found[1][full] - 1e-6)


def counted(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, total (words of the row): texts are counted in their rows, without a shuffle. Rows of no words give none."""
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, tokens in short(batch):
                row, code, tf, length, own = row_counts(tokens)
                for i in range(0, len(row), ROWS):  # few at a time leave the worker
                    r = row[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), own.take(pa.array(code[i : i + ROWS])), pa.array(tf[i : i + ROWS]), pa.array(length[r])], names=[key, "term", "tf", "total"])
        release()

    return docs.select(key, T.lower_words(text, TERM).alias("words")).mapInArrow(run, f"`{key}` {kind}, term string, tf long, total long")


def document_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, df. Rows of one text each are counted in their tasks first, so what is shuffled is the words of tasks, not of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens in short(batch):
                _, code, _, _, own = row_counts(tokens)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.bincount(code, minlength=len(own)))], names=["term", "n"])
        release()

    if not _one_row_each(docs, key):
        return term_counts(docs, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ready(docs.sparkSession)
    words = docs.select(F.lit(0).alias("key"), T.lower_words(text, TERM).alias("words"))
    return words.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


@dataclass
class TfidfVectorizer:
    """idf = ln((1 + N) / (1 + df)) + 1; tf = count / tokens in the vocabulary. The vocabulary is a DataFrame, whatever its size."""

    vocabulary: DataFrame | None = None

    def fit(self, docs: DataFrame, key: str, text: str = "text"):
        n = docs.count()
        df = document_frequencies(docs, key, text)
        self.vocabulary = df.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
        self.__dict__["_fitted"] = (docs, key, text, self.vocabulary)
        return self

    def _knows(self, docs: DataFrame, key: str, text: str) -> bool:
        """Whether this is the table that the vocabulary is of: it then has all of its words."""
        of = self.__dict__.get("_fitted")
        return of is not None and of[3] is self.vocabulary and of[1:3] == (key, text) and of[0].sameSemantics(docs)

    def transform(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, term, weight. Words are shuffled once, to meet the vocabulary; once more by key if some may not be in it, or a key stands for several rows."""
        if self.vocabulary is None:
            raise RuntimeError("fit first")
        single = _one_row_each(docs, key)
        words = counted(docs, key, text) if single else term_counts(docs, key, text)
        known = words.join(self.vocabulary, "term")
        total = F.col("total") if single and self._knows(docs, key, text) else F.sum("tf").over(Window.partitionBy(key))
        return known.select(key, "term", (F.col("tf") / total * F.col("idf")).alias("weight"))


def hashing_vectorize(docs: DataFrame, key: str, text: str = "text", dim: int = 1024) -> DataFrame:
    """key, index, value: signed crc32 hashing of words, with length 1."""
    if dim < 1:
        raise ValueError("dim must be positive")
    h = F.crc32(F.col("w").cast("binary"))
    terms = docs.select(key, F.explode(T.lower_words(text)).alias("w")).select(key, (h % dim).cast("int").alias("index"), F.when(F.shiftright(h, 31) % 2 == 1, -1.0).otherwise(1.0).alias("s"))
    cells = terms.groupBy(key, "index").agg(F.sum("s").alias("value"))
    size = F.greatest(F.lit(1e-12), F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key))))
    return cells.select(key, "index", (F.col("value") / size).alias("value"))


def hash_embed(docs: DataFrame, key: str, text: str = "text", dim: int = 32) -> DataFrame:
    """key, vector: the sum over words of the bytes of their md5 (byte i mod 16 at i), with length 1; zeros for no words or null.

    A text stays in its row: a slice of an Arrow batch at a time hashes its distinct words once, and nothing is shuffled.
    """
    if dim < 4:
        raise ValueError("dim must be 4 at least")

    def run(texts: list) -> pa.Array:
        numbers: dict[str, int] = {}
        rows = [[numbers.setdefault(w, len(numbers)) for w in _PIECE.findall(t or "")] for t in texts]
        bytes_of = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in numbers), np.uint8).reshape(-1, 16)
        at = np.arange(dim) % 16
        out = np.zeros((len(rows), dim))
        for v, r in zip(out, rows):
            if r:
                v[:] = bytes_of[r].sum(0, dtype=np.int64)[at] / 255
            v /= max(1e-12, float(np.sqrt((v * v).sum())))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return docs.select(key, by_slices(run, "array<double>", F.col(text)).alias("vector"))


def _tf(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def bm25_scores(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, text: str = "text", pattern: str = TERM) -> DataFrame:
    """docs with ``score`` for one query. One aggregate over the corpus (N, mean length, df of the query's terms), then a projection."""
    terms = regex.findall(pattern, query.lower())
    distinct = list(dict.fromkeys(terms))
    d = docs.withColumn("_tokens", T.lower_words(F.coalesce(F.col(text), F.lit("")), pattern))
    d = d.select(*docs.columns, F.size("_tokens").alias("_dl"), *[_tf(F.col("_tokens"), t).alias(f"_tf{i}") for i, t in enumerate(distinct)])
    row = d.agg(F.count(F.lit(1)), F.avg("_dl"), *[F.count_if(F.col(f"_tf{i}") > 0) for i in range(len(distinct))]).first()
    n, average, df = row[0], row[1] or 1.0, row[2:]
    score = F.lit(0.0)
    norm = k1 * (1 - b + b * F.col("_dl") / max(average, 1e-9))
    for t in terms:
        i = distinct.index(t)
        tf = F.col(f"_tf{i}").cast("double")
        idf = F.log(F.lit(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + norm)
    return d.select(*docs.columns, score.alias("score"))


def bm25_search(docs: DataFrame, key: str, query: str, k: int = 10, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """key, score of the k best documents; documents without a query term score 0 and fill up."""
    return bm25_scores(docs.select(key, text), query, k1, b, text).select(key, "score").orderBy(F.desc("score"), key).limit(k)


def bm25_search_many(docs: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 10, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """query_key, rank, key, score for a table of queries (query_key, text); documents that share no term are left out.

    The queries' terms go to every worker, documents are read twice and stay in their rows: first for document frequencies and the
    mean length, then for scores, of which a task leaves the k best of each query. Where queries have more than ``QUERY_TERMS`` terms in all,
    or a key stands for several rows, postings joins do the same.
    """
    wanted = queries.select(query_key, F.explode(T.lower_words("text", TERM)).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    asked = wanted.take(QUERY_TERMS + 1)
    many = _search_by_joins if len(asked) > QUERY_TERMS or not _one_row_each(docs, key) else _search_in_rows
    scores = many(docs, key, wanted, asked, query_key, k, k1, b, text)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


def _one_row_each(docs: DataFrame, key: str) -> bool:
    return docs.groupBy(key).count().where("count > 1").isEmpty()


def _search_by_joins(docs: DataFrame, key: str, wanted: DataFrame, asked: list, query_key: str, k: int, k1: float, b: float, text: str) -> DataFrame:
    """query_key, key, score of all documents that share a term, for any number of queries."""
    length = docs.select(key, F.size(T.lower_words(F.coalesce(F.col(text), F.lit("")), TERM)).alias("dl"))
    n, average = length.agg(F.count(F.lit(1)), F.avg("dl")).first()
    # words of no query go before anything is counted or shuffled by document
    said = docs.select(key, F.explode(T.lower_words(text, TERM)).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    hits = said.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (average or 1.0)))
    impact = hits.join(df, "term").join(length, key).select("term", key, (idf * weight).alias("w"))
    return impact.join(wanted, "term").groupBy(query_key, key).agg(F.round(F.sum(F.col("w") * F.col("times")), 6).alias("score"))


def _search_in_rows(docs: DataFrame, key: str, wanted: DataFrame, asked: list, query_key: str, k: int, k1: float, b: float, text: str) -> DataFrame:
    """query_key, key, score: of each task the k best documents of each query."""
    ready(docs.sparkSession)
    asked = sorted(asked, key=lambda r: r["term"])
    names = list(dict.fromkeys(r[query_key] for r in asked))
    at = {q: i for i, q in enumerate(names)}
    terms = list(dict.fromkeys(r["term"] for r in asked))
    of = np.array([at[r[query_key]] for r in asked], np.int64)
    times = np.array([r["times"] for r in asked], float)
    places = {t: i for i, t in enumerate(terms)}
    start = np.searchsorted(np.array([places[r["term"]] for r in asked], np.int64), np.arange(len(terms) + 1))
    kinds, query_kind = dict(docs.dtypes), wanted.schema[query_key].dataType
    words = docs.select(key, T.lower_words(F.coalesce(F.col(text), F.lit("")), TERM).alias("words"))

    def said(tokens: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, ...]:
        """Rows, the terms of queries in them, how often; and the lengths of all rows."""
        row, code, tf, length, own = row_counts(tokens)
        term = pa.compute.index_in(own, known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
        return row[term >= 0], term[term >= 0], tf[term >= 0], length

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each term in how many rows; then how many rows and words."""
        total, known = np.zeros(len(terms) + 2, np.int64), pa.array(terms, pa.string())
        for batch in batches:
            for _, tokens in short(batch):
                _, term, _, length = said(tokens, known)
                total += np.append(np.bincount(term, minlength=len(terms)), [len(length), length.sum()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])
        release()

    total = {r["at"]: r["n"] for r in words.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    df = np.array([total.get(i, 0) for i in range(len(terms))], float)
    n = total.get(len(terms), 0)
    average = (total[len(terms) + 1] / n if n else 0) or 1.0
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, kind = Best(len(names), k), pa.array(terms, pa.string()), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, tokens in short(batch):
                row, term, tf, length = said(tokens, known)
                w = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
                each = start[term + 1] - start[term]
                cost = np.cumsum(np.maximum(np.bincount(row, each, len(keys)), len(names)))
                first = 0
                while first < len(keys):  # as many rows at once as have few sums; one at least
                    end = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + SUMS, "right")))
                    i, j = np.searchsorted(row, [first, end])
                    several = each[i:j]
                    pair = np.repeat(start[term[i:j]] - np.cumsum(several) + several, several) + np.arange(several.sum())
                    sums = np.bincount(np.repeat(row[i:j] - first, several) * len(names) + of[pair], np.repeat(w[i:j], several) * times[pair], (end - first) * len(names))
                    best.meet(keys[first:end], sums.reshape(end - first, len(names)))
                    first = end
        if best.found and len(best.found[0]):
            q, _, s, own = best.found
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], to_arrow_type(query_kind)), pa.array(own.tolist(), kind), pa.array(s)], names=[query_key, key, "score"])
        release()

    found = words.where(F.col(key).isNotNull()).mapInArrow(score, f"`{query_key}` {query_kind.simpleString()}, `{key}` {kinds[key]}, score double")
    return found.withColumn("score", F.round("score", 6))


def chunk_words(docs: DataFrame, key: str, text: str = "text", size: int = 120, overlap: int = 20) -> DataFrame:
    """key, chunk (from 0), text: windows of words, up to the first that isn't full."""
    size = max(1, size)
    step = max(1, size - max(0, min(overlap, size - 1)))
    words = F.split(F.trim(text), r"\s+")
    last = F.when(F.size("_w") < size, 0).otherwise(F.least(F.floor((F.size("_w") - size) / step) + 1, F.floor((F.size("_w") - 1) / step))).cast("int")
    d = docs.where(F.col(text).isNotNull()).select(key, words.alias("_w"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " "))
    return d.select(key, F.posexplode(cut).alias("chunk", "text"))


def split_text(docs: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 120, trim: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, chunk, id (key#chunk-n), start, text, and the columns ``keep``: character windows; one that holds only overlap is kept too. Blank texts give none."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    body = F.trim(text) if trim else F.col(text)
    d = docs.select(key, *keep, body.alias("_t")).where("trim(_t) <> ''")
    at = d.select(key, *keep, "_t", F.posexplode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(step))).alias("chunk", "start"))
    return at.select(key, "chunk", F.concat(F.col(key).cast("string"), F.lit("#chunk-"), F.col("chunk").cast("string")).alias("id"), "start", F.substr("_t", F.col("start") + 1, F.lit(size)).alias("text"), *keep)


def cosine_search(items: DataFrame, query: list[float], k: int = 5, filters: dict | None = None, vector: str = "vector", key: str = "id") -> DataFrame:
    """items with ``score``, the k best by cosine; ``filters`` are equalities on columns, or on the map column metadata."""
    d = items
    for name, value in (filters or {}).items():
        d = d.where((F.col(name) if name in items.columns else F.col("metadata")[name]).eqNullSafe(F.lit(value)))
    v = F.array(*[F.lit(float(x)) for x in query])
    return d.withColumn("score", V.cosine(vector, v)).orderBy(F.desc("score"), key).limit(max(1, k))


def ascii_terms(text: str) -> list[str]:
    return re.findall(ASCII_TERM, text.lower())


def lexical_score(text: Column | str, query: str) -> Column:
    """BM25-like, without corpus statistics: mean length 100."""
    tokens = T.lower_words(text, ASCII_TERM)
    norm = 1.5 * (0.25 + 0.75 * F.size(tokens) / 100.0)
    out = F.lit(0.0)
    for t in ascii_terms(query):
        tf = _tf(tokens, t).cast("double")
        out = out + tf * 2.5 / (tf + norm)
    return out


def hybrid_search(items: DataFrame, query: str, vector: list[float], k: int = 5, dense_weight: float = 0.7, filters: dict | None = None, key: str = "id") -> DataFrame:
    """The max(10, 3k) nearest items, ranked by dense_weight x cosine + (1 - dense_weight) x lexical score; k remain."""
    near = cosine_search(items, vector, max(10, 3 * k), filters, key=key).withColumnRenamed("score", "dense_score").withColumn("lexical_score", lexical_score("text", query))
    return near.withColumn("score", dense_weight * F.col("dense_score") + (1 - dense_weight) * F.col("lexical_score")).orderBy(F.desc("score"), F.desc("dense_score"), key).limit(max(1, k))


def rerank_lexical(hits: DataFrame, query: str, base_weight: float = 0.7, text: str = "text") -> DataFrame:
    """score = base_weight x score + (1 - base_weight) x Jaccard of the term sets (1 if both are empty)."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(ascii_terms(query))]).cast("array<string>")
    overlap = T.jaccard(T.lower_words(text, ASCII_TERM), q, empty=1.0)
    return hits.withColumn("lexical_overlap", overlap).withColumn("score", base_weight * F.col("score") + (1 - base_weight) * F.col("lexical_overlap"))


def expand_query(query: str, most: int = 3) -> list[str]:
    return list(dict.fromkeys([query, f"{query} explanation", f"about {query}"]))[: max(1, most)]


def qa_prompt(question: str, texts: list[str]) -> str:
    context = "\n\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))
    return f"Answer from the context alone.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"


def verify_grounding(answer: str, scores: list[float]) -> list[str]:
    """What is wrong with an answer; nothing, if it is grounded."""
    issues = []
    if not answer.strip():
        issues.append("empty answer")
    if not scores:
        issues.append("no contexts")
    if not any(s > 0 for s in scores):
        issues.append("no context scores above zero")
    return issues


def format_hits(hits: DataFrame, key: str, order: list[Column], text: str = "text") -> DataFrame:
    """One row, ``formatted``: numbered lines of id, score and text. For top-k results."""
    n = F.row_number().over(Window.orderBy(*order))
    lines = hits.select(n.alias("n"), F.format_string("[%d] doc=%s score=%.4f %s", n, F.col(key).cast("string"), "score", text).alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("formatted"))


def echo(prompt: str, prefix: str = "Echo: ", most: int = 240) -> str:
    """The stand-in for a language model."""
    return prefix + prompt[:most]


def stream(text: str, size: int = 40):
    for i in range(0, len(text), size):
        yield text[i : i + size]


@dataclass
class QaChain:
    """Index documents as embedded chunks, then answer questions: expand, retrieve, rerank, prompt, generate, verify."""

    embed: Callable[[DataFrame], DataFrame]  # adds vector to (id, text, ...)
    embed_query: Callable[[str], list[float]]
    generate: Callable[[str], str] = echo
    expand: Callable[[str], list[str]] = lambda q: [q]
    size: int = 800
    overlap: int = 120
    items: DataFrame | None = field(default=None)

    def index(self, docs: DataFrame, key: str, text: str = "text"):
        chunks = split_text(docs, key, text, self.size, self.overlap)
        self.items = self.embed(chunks)
        return self

    def contexts(self, question: str, k: int = 5, filters: dict | None = None) -> DataFrame:
        if self.items is None:
            raise RuntimeError("index first")
        found = None
        for q in self.expand(question):
            hits = cosine_search(self.items, self.embed_query(q), k, filters)
            found = hits if found is None else found.unionByName(hits)
        best = found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))).where("_n = 1").drop("_n")
        return rerank_lexical(best, question).orderBy(F.desc("score"), "id").limit(max(1, k))

    def ask(self, question: str, k: int = 5, filters: dict | None = None) -> dict:
        rows = self.contexts(question, k, filters).collect()  # k rows
        answer = self.generate(qa_prompt(question, [r.text for r in rows]))
        scores = [r.score for r in rows]
        issues = verify_grounding(answer, scores)
        return {"answer": answer, "contexts": rows, "citations": [r.id for r in rows], "diagnostics": {"query_count": len(self.expand(question)), "avg_score": sum(scores) / len(scores) if scores else 0.0, "scores": scores}, "verification": {"is_valid": not issues, "issues": issues}}

    def ask_stream(self, question: str, k: int = 5, filters: dict | None = None):
        yield from stream(self.ask(question, k, filters)["answer"])


def remote_embed(texts: DataFrame, post: Callable[[list[str]], list[list[float]]], key: str = "id", text: str = "text", batch: int = 64) -> DataFrame:
    """key, vector from an injected transport that embeds a list of texts; nulls count as empty texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts):
        for b in parts:
            ts = [t or "" for t in b[text]]
            vs = [v for i in range(0, len(ts), batch) for v in post(ts[i : i + batch])]
            yield pd.DataFrame({key: b[key], "vector": vs})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<double>")
