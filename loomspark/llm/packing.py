"""Best-fit packing of documents into fixed-size token sequences (bounded-space, online)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, token_estimate, written
from .token_counts import document_tokens

SCHEMA = "shard int, bin long, bin_offset int, doc_id long, piece int, start long, n_tokens int"
ARROW = pa.schema([("shard", pa.int32()), ("bin", pa.int64()), ("bin_offset", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])


class Packer:
    """Open bins keyed by free space in one integer used as a bitset.

    A piece goes to the open bin with the least free space that holds it, the oldest among equals. When none
    holds it and all ``open_bins`` are in use, the fullest one closes (the oldest among equals). A bin that
    gets full closes at once.
    """

    def __init__(self, capacity: int, open_bins: int):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.n_open, self.next = 0, 0, 0
        self.by_free: list[deque[int]] = [deque() for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        queue = self.by_free[free]
        bin_id = queue.popleft()
        if not queue:
            self.bits ^= 1 << free
        self.n_open -= 1
        return bin_id

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset in it for a piece of n tokens, 1 <= n <= capacity."""
        rest = self.bits >> n
        if rest:
            free = n + (rest & -rest).bit_length() - 1
            bin_id = self._take(free)
        else:
            free = self.capacity
            if n < free and self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, self.next = self.next, self.next + 1
        left = free - n
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free


def pack(docs: DataFrame, capacity: int = 2048, open_bins: int = 64, docs_per_shard: int = 50_000, token_col: str | None = None) -> DataFrame:
    """Where each piece of each document goes: shard, bin, bin_offset, doc_id, piece, start, n_tokens.

    Lengths are ``token_col`` or four bytes of text a token. A document longer than ``capacity`` is cut into full
    pieces, each a bin of its own, and a remainder that is packed like any other. Shards pack independently (one
    for each ``docs_per_shard`` documents, by hash of doc_id), in the order doc_id, length; a bin is named by
    (shard, bin). State is ``open_bins`` bins a shard however large the shard is; a shard is a task, which isn't merged with others.

    Null or empty text, or no tokens: no row. A null doc_id is packed as a document without an id (first in its
    shard). Repeated rows are packed once each; ties in order are rows of the same id and length, whose places
    are interchangeable. A text of any length is cut into pieces. No documents: no rows. Other columns are ignored.
    """
    tokens = F.col(token_col).cast("long") if token_col else token_estimate(F.col("text"))
    shards = max(1, -(-docs.count() // docs_per_shard))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n")).where("n > 0")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            out: list[tuple] = []
            add = out.append
            for doc_id, n, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "shard"))):
                if shard != now:
                    now, packer = shard, Packer(capacity, open_bins)
                piece = start = 0
                while start < n:
                    size = min(capacity, n - start)
                    bin_id, offset = packer.place(size)
                    add((shard, bin_id, offset, doc_id, piece, start, size))
                    piece, start = piece + 1, start + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    return map_batches(sized.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n"), run, SCHEMA)


def pack_tokens(docs: DataFrame, **parameters) -> DataFrame:
    """``pack`` by exact tokens: start and n_tokens are positions in the encoding of ``token_counts``, and no bin holds more than ``capacity``.

    Texts are encoded once; the counts are written, as ``pack`` reads them twice.
    """
    return pack(written(document_tokens(docs)), token_col="n_tokens", **parameters)
