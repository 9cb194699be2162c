"""Exact BM25 top-k by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .kernels import pieces, span_hashes, words

LEVELS = 255
STEP = 2048  # postings between two looks at the proof, at first
FEW = 64  # possible members that are cheaper to rescore than to thin out, times k
SLACK = 2e-6  # scores are ranked at six decimals


@dataclass
class Queries:
    """Query terms by number, and each query's (term, times) pairs."""

    ids: list
    vocabulary: np.ndarray  # sorted hashes
    terms: list[np.ndarray]
    times: list[np.ndarray]


def read_queries(rows: list[tuple]) -> Queries:
    text = pa.array([t or "" for _, t in rows], pa.string())
    hashes: list[np.ndarray] = []
    for _, _, raw, offsets in pieces(text):
        starts, ends, first = words(raw, offsets)
        h = span_hashes(raw, starts, ends)
        hashes += [h[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    counted = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for h in hashes]
    return Queries([i for i, _ in rows], vocabulary, [t for t, _ in counted], [n for _, n in counted])


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, length in words, and the query terms in the document with their counts (terms ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for at, end, raw, offsets in pieces(batch.column("text")):
                starts, ends, first = words(raw, offsets)
                h = span_hashes(raw, starts, ends)
                term = np.searchsorted(vocabulary, h)
                hit = np.flatnonzero(vocabulary[np.minimum(term, size - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
                row = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(row * size + term[hit], return_counts=True)
                of = pa.array(np.searchsorted(key, np.arange(len(offsets)) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(of, pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(np.diff(first).astype(np.int32)), *lists], ["doc_id", "length", "terms", "tfs"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return map_batches(rows, run, "doc_id long, length int, terms array<int>, tfs array<int>")


class Shard:
    """The index of some documents: each term's postings in segments of equal quantised impact, by descending impact.

    A posting's impact is its BM25 weight in units of ``unit``, rounded up; its weight is above impact - 1 units.
    """

    def __init__(self, ids: np.ndarray, length: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, unit: float, average: float, k1: float, b: float):
        self.ids, self.first, self.term, self.unit = ids, first, term, unit
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        norm = k1 * (1 - b + b * length / average)
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm[doc])
        impact = np.maximum(1, np.ceil(self.weight / unit - 1e-12)).astype(np.int64)
        order = np.lexsort((doc, -impact, term))
        self.doc = doc[order]
        t, v = term[order], impact[order]
        self.begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])) if len(t) else np.zeros(0, np.int64)
        self.end = np.append(self.begin[1:], len(t))
        self.segment_impact = v[self.begin]
        self.of_term = np.searchsorted(t[self.begin], np.arange(len(idf) + 1))

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that may be among the k best, given that ``floor`` is already reached k times elsewhere."""
        n = self.of_term[terms + 1] - self.of_term[terms]
        seg = np.repeat(self.of_term[terms], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(seg):
            return np.zeros(0, np.int64), np.zeros(0)
        which, mult = np.repeat(np.arange(len(terms)), n), np.repeat(times, n)
        value = self.segment_impact[seg] * mult
        order = np.argsort(-value, kind="stable")
        seg, which, mult, value = seg[order], which[order], mult[order], value[order]
        size = self.end[seg] - self.begin[seg]
        done = np.cumsum(size)
        high = np.zeros(len(self.ids), np.int64)  # impacts seen
        loose = np.zeros(len(self.ids), np.int64)  # by how many units they may be too high
        at, step, floor_units = 0, STEP, max(0.0, (floor - SLACK) / self.unit)
        while True:
            left = int(value[at:][np.unique(which[at:], return_index=True)[1]].sum())
            least = floor_units
            if at and len(high) >= k:
                low = high - loose
                least = max(least, float(np.partition(low, -k)[-k]) - SLACK / self.unit)
            if at == len(seg) or left < least:  # no document unseen so far can reach the k best
                members = np.flatnonzero((high + left >= least) & (high > 0))
                if at == len(seg) or len(members) <= FEW * k:
                    break
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
            to, step = min(to, len(seg)), step * 2
            m = size[at:to]
            post = np.repeat(self.begin[seg[at:to]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            d = self.doc[post]
            np.add.at(high, d, np.repeat(value[at:to], m))
            np.add.at(loose, d, np.repeat(mult[at:to], m))
            at = to
        return members, self.exact(members, terms, times)

    def exact(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        m = self.first[docs + 1] - self.first[docs]
        post = np.repeat(self.first[docs], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        times_of = np.zeros(len(self.of_term) - 1)
        times_of[terms] = times
        return np.bincount(np.repeat(np.arange(len(docs)), m), self.weight[post] * times_of[self.term[post]], len(docs)).round(6)


def _search(index: DataFrame, q: Queries, idf: np.ndarray, unit: float, average: float, k: int, k1: float, b: float, shard_docs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q.ids)

        def visit(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            first = terms.offsets.to_numpy().astype(np.int64)
            shard = Shard(table.column("doc_id").to_numpy(), table.column("length").to_numpy(), first - first[0], terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.float64), idf, unit, average, k1, b)
            for i in range(len(q.ids)):
                ids, scores = best[i]
                members, exact = shard.top(q.terms[i], q.times[i], k, scores[k - 1] if len(scores) >= k else 0.0)
                if len(members):
                    ids, scores = np.concatenate([ids, shard.ids[members]]), np.concatenate([scores, exact])
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]

        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= shard_docs:
                visit(parts)
                parts, rows = [], 0
        if rows:
            visit(parts)
        n = [len(s) for _, s in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q.ids)), n)), pa.array(np.concatenate([x for x, _ in best])), pa.array(np.concatenate([s for _, s in best]))],
            ["query", "doc_id", "score"],
        )

    return map_batches(index, run, "query long, doc_id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "item_id", queries_per_pass: int = 5000, shard_docs: int = 65_536) -> DataFrame:
    """query id, rank, doc_id, score: for every row of queries its k best documents by BM25, exactly; ties by doc_id.

    Words are runs of ASCII letters and digits and of all non-ASCII characters in the lower-cased text; a repeated query word
    counts as often as it occurs; idf = ln(1 + (N - df + .5) / (df + .5)); scores are rounded to six decimals, then ranked.

    One scan writes each document's postings for the query terms; statistics come from that index. Each task then holds
    shards of at most ``shard_docs`` documents with posting segments by descending quantised impact, adds segments up in
    order of impact until bounds prove that no other document can be among the k best, and rescores the possible members
    exactly. Only k rows a query and task are shuffled. Queries are held in memory, ``queries_per_pass`` at a time.

    Documents with a null doc_id or null text don't count; empty ones do. A query without a known word, null or empty: no row; a
    null query id is carried. Repeated rows of documents rank separately, repeated queries have a result each. A document
    without any query word is never a result, so there may be fewer than k. Empty tables: no rows. Other columns are
    ignored.
    """
    source = queries.select(F.col(id_col).alias("id"), F.lower("text").alias("text")).where("text is not null")
    kind = source.schema["id"].dataType.simpleString()
    found: DataFrame | None = None
    rows: list[tuple] = []

    def batch(rows: list[tuple]) -> DataFrame:
        q = read_queries(rows)
        index = written(postings(docs, q.vocabulary))
        n, total = index.agg(F.count(F.lit(1)), F.sum("length")).first()
        df = np.zeros(len(q.vocabulary))
        for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = count
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        unit = float(idf.max(initial=1e-9)) * (k1 + 1) / LEVELS
        names = docs.sparkSession.createDataFrame(list(enumerate(q.ids)), f"query long, {id_col} {kind}")
        part = _search(index, q, idf, unit, max(float(total or 0) / max(n, 1), 1e-9), k, k1, b, shard_docs)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.join(names, "query").select(id_col, "rank", "doc_id", "score")

    for row in source.toLocalIterator():
        rows.append((row.id, row.text))
        if len(rows) == queries_per_pass:
            found, rows = (batch(rows) if found is None else found.unionByName(batch(rows))), []
    if rows:
        found = batch(rows) if found is None else found.unionByName(batch(rows))
    return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score double") if found is None else found


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') ws from documents where doc_id is not null and text is not null),
q as (select item_id, w, count(*) times from (select item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')) w from benchmark) group by all),
p as (select doc_id, dl, w, count(*) tf from (select doc_id, len(ws) dl, unnest(ws) w from d) where w in (select w from q) group by all),
g as (select count(*) n, avg(len(ws)) avgdl from d),
f as (select w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from p, g group by w, n),
s as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (w) join f using (w), g group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
