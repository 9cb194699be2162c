"""The nearest rows of blocks of vectors: candidates from products in single precision, distances of those in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ready, release

TILE, CANDIDATES, TOGETHER = 512, 1 << 16, 32  # queries of a product, candidates measured at once, blocks of a partition that all queries meet


def _list(a: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def _copies(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without all but the ``most`` first of equal vectors: no others can be among the nearest."""
    if len(np.unique(ids)) < len(ids):  # rows of one id are left out together
        return np.arange(len(ids))
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    start = np.flatnonzero(np.diff(same[order], prepend=-1))
    at = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return np.sort(order[at < most])


def packed(side: DataFrame, block: int, together: int, most: int | None = None) -> DataFrame:
    """Columns i, x and the rest of ``side`` as rows of up to ``block``: ids, vectors as the bytes of doubles, and the rest as lists.

    What isn't finite is near nothing and left out. ``most``: how many equal vectors of a block are kept.
    """
    ready(side.sparkSession)
    blocks = max(1, -(-side.count() // block))
    rest = side.columns[2:]
    kinds = dict(side.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        for first in range(0, whole.num_rows if whole else 0, block):
            t = whole.slice(first, block).combine_chunks()
            x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
            keep = np.flatnonzero(np.isfinite(x).all(1))
            if most and len(keep):
                keep = keep[_copies(x[keep], np.array(t["i"].to_pylist())[keep], most)]
            if len(keep):
                own = t.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([_list(own["i"].combine_chunks()), pa.array([x[keep].tobytes()], pa.binary()), *[_list(own[c].combine_chunks()) for c in rest]], names=["i", "x", *rest])
        release()

    spread = side.repartition(blocks).mapInArrow(run, ", ".join([f"i array<{kinds['i']}>", "x binary", *[f"`{c}` array<{kinds[c]}>" for c in rest]]))
    return spread.repartition(-(-blocks // together))


class Nearest:
    """The k nearest of the blocks seen so far, for each row of one block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.x, self.k, self.exclude_self = ids, x, k, exclude_self
        self.kth = np.full(len(x), np.inf)
        self.found: tuple[np.ndarray, ...] | None = None  # row, distance, id, label in this order
        self.middle = np.median(x, 0)  # not drawn away by what is far out
        most = float(np.abs(x - self.middle).max())
        self.scale = 2.0 ** -np.ceil(np.log2(most)) if 0 < most < 1e300 and most > 1e-300 else 1.0
        own = (x - self.middle) * self.scale
        self.square = (own * own).sum(1)
        self.g = (x.shape[1] + 16) * 2.0**-23  # of both squares: more than single precision can be wrong by
        self.own = np.column_stack([-2 * own, np.ones(len(x))]).astype(np.float32)

    def _distances(self, q: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((b[t[i : i + CANDIDATES]] - self.x[q[i : i + CANDIDATES]]) ** 2).sum(1)) for i in range(0, len(q), CANDIDATES)] or [np.zeros(0)])

    def _bound(self, rows: np.ndarray, near: np.ndarray, ids: np.ndarray, b: np.ndarray) -> None:
        """A first bound for rows without one: the k-th distance of any k others."""
        k = self.k
        if near.shape[1] <= k:
            return
        t = np.argpartition(near, k, 1)[:, : k + 1].ravel()
        q = np.repeat(rows, k + 1)
        d = self._distances(q, t, b)
        if self.exclude_self:
            d[ids[t] == self.ids[q]] = np.inf
        self.kth[rows] = np.sort(d.reshape(-1, k + 1), 1)[:, k - 1]

    def meet(self, ids: np.ndarray, b: np.ndarray, labels: np.ndarray) -> None:
        g, new = self.g, []
        theirs = (b - self.middle) * self.scale
        square = (theirs * theirs).sum(1)
        far = ~(square < 1e30)  # beyond single precision: always measured
        theirs[far], square[far] = 0, -1e38
        other = np.column_stack([theirs, square * (1 - g)]).astype(np.float32).T
        for first in range(0, len(self.x), TILE):
            rows = np.arange(first, min(first + TILE, len(self.x)))
            near = self.own[rows] @ other
            open_ = np.flatnonzero(np.isinf(self.kth[rows]))
            if len(open_):
                self._bound(rows[open_], near[open_], ids, b)
            reach = self.kth[rows] * self.scale
            with np.errstate(over="ignore"):
                reach = (reach * reach * (1 + g) - self.square[rows] * (1 - g) + 1e-36).astype(np.float32)
            at = np.flatnonzero(near <= reach[:, None])
            for i in range(0, len(at), 16 * CANDIDATES):
                q, t = np.divmod(at[i : i + 16 * CANDIDATES], len(b))
                q += first
                if self.exclude_self:
                    other_id = ids[t] != self.ids[q]
                    q, t = q[other_id], t[other_id]
                d = self._distances(q, t, b)
                keep = np.isfinite(d) & (d <= self.kth[q])
                new.append((q[keep], d[keep], ids[t[keep]], labels[t[keep]]))
                if len(at) > 16 * CANDIDATES:
                    self._merge(new)
                    new = []
        self._merge(new)

    def _merge(self, new: list[tuple[np.ndarray, ...]]) -> None:
        if not sum(len(n[0]) for n in new):
            return
        q, d, n, y = (np.concatenate(c) for c in zip(*([self.found] if self.found else []), *new))
        order = np.lexsort((n, d, q))
        q = q[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        at = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        keep = at < self.k
        order, q, at = order[keep], q[keep], at[keep]
        self.found = q, d[order], n[order], y[order]
        full = at == self.k - 1
        self.kth[q[full]] = self.found[1][full]


def pairs(left: DataFrame, right: DataFrame, k: int, exclude_self: bool, schema: str) -> DataFrame:
    """i, n, label, distance: for each row of ``left`` (i, x) at least its k nearest of ``right`` (i, x, y), k at most of each partition of it."""

    def values(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
        return np.array(batch.column(name)[at].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, state = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if state and state.found:
                q, d, n, y = state.found
                yield pa.RecordBatch.from_arrays([pa.array(state.ids[q].tolist(), kinds[0]), pa.array(n.tolist(), kinds[1]), pa.array(y.tolist(), kinds[2]), pa.array(d)], names=["i", "n", "label", "distance"])

        for b in batches:
            kinds = [b.schema.field(c).type.value_type for c in ("qi", "ti", "ty")]
            for at in range(b.num_rows):
                if b.column("q")[at].as_py() != seen:  # a block of queries meets the blocks of a partition one after the other
                    yield from out()
                    ids = values(b, "qi", at)
                    seen, state = b.column("q")[at].as_py(), Nearest(ids, np.frombuffer(b.column("qx")[at].as_buffer()).reshape(len(ids), -1).copy(), k, exclude_self)
                ids = values(b, "ti", at)
                state.meet(ids, np.frombuffer(b.column("tx")[at].as_buffer()).reshape(len(ids), -1), values(b, "ty", at))
        yield from out()
        release()

    both = left.select(F.monotonically_increasing_id().alias("q"), F.col("i").alias("qi"), F.col("x").alias("qx")).crossJoin(right.select(F.col("i").alias("ti"), F.col("x").alias("tx"), F.col("y").alias("ty")))
    return both.mapInArrow(run, schema)
