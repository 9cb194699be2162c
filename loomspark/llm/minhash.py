"""Near-duplicate groups by DartMinHash signatures of weighted word pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, cut, written
from .kernels import U64, mix, pieces, span_hashes, words

# cumulative probabilities of a Poisson variable of mean 1, on 16 bits
_POISSON = np.floor(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]) * 65536).astype(np.uint32)
_COUNT = np.searchsorted(_POISSON, np.arange(65536), "right").astype(np.uint8)
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def dart_signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) signatures of weighted sets; ``first`` has the index of each set's first element, and one past the last.

    Darts are a Poisson process of rate 1 over element x weight x rank, cast by hashing, hence the same for every set. A set
    owns the darts below the weights of its elements; each dart falls to one of k coordinates, where the owned one of least
    rank stays. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Ranks are
    visited up to k (ln k + 2) / total weight, and on for the few sets with an empty coordinate. A set without weight has
    no signature (all entries alike).
    """
    n = len(first) - 1
    sig = np.full(n * k, _NONE, U64)
    owner = np.repeat(np.arange(n), np.diff(first))
    layers = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    height = np.minimum(1.0, weight[at] - layer)  # of this unit layer, the part that the set owns
    seed = mix(element[at] + layer.astype(U64) * U64(0xA24BAED4963EE407))
    owner = owner[at]
    total = np.bincount(owner, height, n)
    reach = k * (math.log(k) + 2) / np.maximum(total, 1e-9)
    low, high = np.zeros(n, np.int64), np.ceil(reach).astype(np.int64)
    while len(owner):
        cells = (high - low)[owner]
        u = np.repeat(np.arange(len(owner)), cells)
        rank = np.arange(len(u)) - np.repeat(np.cumsum(cells) - cells, cells) + low[owner[u]]
        h = mix(seed[u] + rank.astype(U64) * U64(0x9FB21C651E98DF25))
        count = _COUNT[(h & U64(0xFFFF)).astype(np.int64)]
        some = np.flatnonzero(count)
        count = count[some]
        d = np.repeat(some, count)
        nth = np.arange(len(d)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
        dart = mix(h[d] + (nth.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))
        who = u[d]
        # 20 bits of weight, 24 of rank within the cell, 20 of coordinate
        keep = (dart >> U64(44)).astype(np.float64) * 2.0**-20 < height[who]
        d, dart, who = d[keep], dart[keep], who[keep]
        coordinate = (dart & U64(0xFFFFF)) * U64(k) >> U64(20)
        # rank on 40 bits, then 24 that name the dart
        value = rank[d].astype(U64) << U64(48) | ((dart >> U64(20)) & U64(0xFFFFFF)) << U64(24) | mix(dart) >> U64(40)
        np.minimum.at(sig, owner[who] * k + coordinate.astype(np.int64), value)
        empty = (sig.reshape(n, k) == _NONE).any(1) & (total > 0)
        if not empty.any():
            break
        go = empty[owner]
        owner, seed, height = owner[go], seed[go], height[go]
        reach = np.where(empty, 2.0 * high, high)
        low, high = high, reach.astype(np.int64)
    return sig.reshape(n, k)


def weighted_pairs(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word pairs of each row (ASCII case folded), weights 1 + ln(count), and the row offsets. A one-word row has that word."""
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, first = words(raw, offsets)
    h = span_hashes(raw, starts, ends)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(offsets) - 1), n_words)
    pair = np.zeros(len(h), U64)
    if len(h):
        pair[:-1] = mix(h[:-1] * U64(3) + h[1:])
    last = first[1:][n_words > 0] - 1
    alone = n_words[n_words > 0] == 1
    pair[last[alone]] = h[last[alone]]
    drop = np.zeros(len(h), bool)
    drop[last[~alone]] = True
    pair, row = pair[~drop], row[~drop]
    key = row.astype(U64) << U64(54) | pair >> U64(10)  # pieces have at most 1024 rows; 54 bits name a pair
    key.sort()
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(head, len(key)))
    key = key[head]
    row = (key >> U64(54)).astype(np.int64)
    pair = mix(key & U64((1 << 54) - 1))
    return pair, 1.0 + np.log(tf), np.searchsorted(row, np.arange(len(offsets)))


def signatures(docs: DataFrame, k: int = 128) -> DataFrame:
    """doc_id, sig (binary, k 32-bit integers). Rows with a null doc_id or without any word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for at, end, raw, offsets in pieces(text):
                element, weight, first = weighted_pairs(raw, offsets)
                has = np.diff(first) > 0
                rows = (mix(dart_signatures(element, weight, first, k)) >> U64(32)).astype(np.uint32)[has]
                sig = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at).filter(pa.array(has)), sig], ["doc_id", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    return map_batches(rows, run, "doc_id long, sig binary")


def band_keys(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key: one row for each band."""
    width = rows * 4
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(bands)])
    return sigs.select("doc_id", F.explode(keys).alias("key"))


def _agreement(pairs: DataFrame, k: int) -> DataFrame:
    """a, b, similarity: the share of coordinates in which sig_a and sig_b agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, k) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(1))], ["a", "b", "similarity"])

    return map_batches(pairs.select("a", "b", "sa", "sb"), run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of edges (a, b), by alternating large-star and small-star steps."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _compared(pairs: DataFrame, sigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """a, b of the pairs whose signatures agree in ``threshold`` of their coordinates at least."""
    left, right = (sigs.select(F.col("doc_id").alias(x), F.col("sig").alias(f"s{x}")) for x in ("a", "b"))
    return _agreement(pairs.join(left, "a").join(right, "b"), k).where(F.col("similarity") >= threshold).select("a", "b")


def _within(rest: DataFrame, group: list[str]) -> DataFrame:
    """a, b: the pairs of rest's rows of equal ``group`` whose roots differ."""
    a, b = (rest.select(*group, F.col("doc_id").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    return a.join(b, group).where("ra < rb").select("a", "b")


def _several(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, n: the groups of rows with several roots."""
    return rows.groupBy(*group).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select(*group, "n")


def _left_open(keys: DataFrame, roots: DataFrame, sigs: DataFrame, k: int, threshold: float, small: int) -> DataFrame:
    """a, b: all pairs that meet in a band, aren't in one group yet and can agree in ``threshold`` of their coordinates.

    Only bands that hold several groups are looked at. A band of at most ``small`` documents gives its pairs, at most half of
    ``small`` for each of its rows. In a larger one, documents are sets of k (coordinate, value) tokens, and two that share
    a = ceil(threshold k) of them share one among the first k - a + 1 of each in order of frequency, rarest first (the prefix
    filter). So what many documents of a band have in common, as passages that they share, doesn't bring them together.
    """
    own = keys.join(roots, keys.doc_id == roots.node, "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rest = written(own.join(_several(own, ["key"]), "key"))
    pairs = _within(rest.where(F.col("n") <= small), ["key"])
    large = rest.where(F.col("n") > small).drop("n")
    if not large.isEmpty():
        first = k - math.ceil(threshold * k - 1e-9) + 1
        values = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.substring("sig", 4 * j + 1, 4))
        tokens = large.join(sigs, "doc_id").select("key", "doc_id", "root", F.posexplode(values).alias("j", "v"))
        seen = tokens.groupBy("key", "j", "v").agg(F.count(F.lit(1)).alias("seen"))
        order = Window.partitionBy("key", "doc_id").orderBy("seen", "j", "v")
        prefix = tokens.join(seen, ["key", "j", "v"]).withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= first) & (F.col("seen") > 1))
        prefix = written(prefix.select("key", "j", "v", "doc_id", "root"))
        pairs = pairs.unionByName(_within(prefix.join(_several(prefix, ["key", "j", "v"]), ["key", "j", "v"]), ["key", "j", "v"]))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, k: int = 128, bands: int = 32, threshold: float = 0.62, small: int = 64) -> DataFrame:
    """doc_id, duplicate_of for every document that has a near duplicate of lesser doc_id; duplicate_of is its group's least doc_id.

    Similarity is the weighted Jaccard of word pairs, weights 1 + ln(count), estimated from k DartMinHash coordinates. Documents
    that meet in any of ``bands`` bands are candidates; candidates whose estimate reaches ``threshold`` are joined, and groups
    are the connected components of all of these, exactly. Documents of equal signature are one, named by the least of them, from
    the first shuffle on, so copies never meet in bands. First each document of a band is held against the band's least
    one, which joins most of a group of any size at a comparison a document and band; then all candidates that are still in
    different groups are compared (``_left_open``), so no pair that could join two groups is left out. The threshold
    lies below the 0.7 that counts as a near duplicate by about two standard errors, to keep recall.

    A null doc_id, and null text or text without words: not compared, no row. Rows with the same doc_id are one document. A text
    of any length has a signature of k coordinates. No documents, or no duplicates: no rows. Other columns are ignored.
    """
    if k % bands:
        raise ValueError("bands must divide k")
    sigs = written(signatures(docs, k))
    named = sigs.select("doc_id", F.xxhash64("sig").alias("c1"), F.xxhash64(F.lit(1), "sig").alias("c2"))
    classes = written(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    copies = named.join(classes.where("n > 1").select("c1", "c2", "rep"), ["c1", "c2"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    reps = written(sigs.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    keys = band_keys(reps, bands, k // bands)
    least = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last").select("key", "b")
    pairs = keys.select(F.col("doc_id").alias("a"), "key").join(least, "key").where("a <> b").select("a", "b").distinct()
    roots = components(_compared(pairs, reps, k, threshold))
    more = written(_compared(_left_open(keys, roots, reps, k, threshold, small), reps, k, threshold))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    found = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))
    again = copies.join(roots, copies.rep == roots.node, "left").select("doc_id", F.coalesce("root", "rep").alias("duplicate_of"))
    return found.unionByName(again)


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs without near duplicates of others: of each group the least doc_id stays, and equal rows of it stay once.

    Rows of equal doc_id and different texts are one document: all stay or all go. Rows with a null doc_id, or without words, stay.
    """
    gone = near_duplicates(docs, **parameters).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
