"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .kernels import U64, mix, pieces

_RUN = U64(0xD1B54A32D192ED03)
_BASE = 0x8CB92BA72F3D8DD7
_POW = np.array([pow(_BASE, i, 1 << 64) for i in range(64)], U64)


def _tosses() -> np.ndarray:
    """For labels x, y < 256 at x << 8 | y: twice the lowest bit in which x differs from y, plus x's bit there."""
    x, y = np.divmod(np.arange(65536), 256)
    low = (x ^ y) & -(x ^ y)
    bit = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return (2 * bit + (x >> bit & 1)).astype(np.uint8)


_TOSS = _tosses()


def coin_labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours, by four rounds of deterministic coin tossing against the left neighbour.

    names: no two neighbours in a row are equal. first: marks each row's first symbol, which is tossed against itself with the
    lowest bit flipped.
    """
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = names[first] ^ U64(1)
    differ = names ^ left
    low = differ & (~differ + U64(1))
    bit = ((low.astype(np.float64).view(np.int64) >> 52) - 1023).astype(U64)
    label = (U64(2) * bit + (names >> bit & U64(1))).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS[label.astype(np.uint16) << 8 | before]
    return label


def parse(names: np.ndarray, first: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level: the phrases' names, which of them begin a row, and where they begin.

    Runs of one symbol become one; phrases begin at a row's first symbol and at each local maximum of the labels. A boundary
    depends on four symbols to its left and one to its right (and the runs they stand for), nothing else.
    """
    if not len(names):
        return names, first, begin
    head = first.copy()
    head[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(names)))
    names, first, begin = names[at], first[at], begin[at]
    runs = length > 1
    names = names.copy()
    names[runs] = mix(names[runs] + length[runs].astype(U64) * _RUN)
    label = coin_labels(names, first)
    right = np.zeros_like(label)
    right[:-1] = label[1:]
    right[:-1][first[1:]] = 0
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[0] = 255
    peak = (label > left) & (label > right)
    peak |= first
    at = np.flatnonzero(peak)
    within = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    value = mix(names) * _POW[within]
    phrase = mix(np.add.reduceat(value, at) + np.diff(np.append(at, len(names))).astype(U64))
    return phrase, first[at], begin[at]


def hierarchy(raw: np.ndarray, offsets: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 1: names and byte starts of its phrases, and each row's range of them (n+1 entries)."""
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    names, begin = mix(raw.astype(U64) + U64(1)), np.arange(len(raw))
    for _ in range(levels):
        names, first, begin = parse(names, first, begin)
        yield names, begin, np.searchsorted(begin, offsets)


def fingerprint(raw: np.ndarray, offsets: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last level of ``hierarchy``."""
    *_, last = hierarchy(raw, offsets, levels)
    return last


def _lists(names: np.ndarray, of: np.ndarray, null: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(of, pa.int32(), mask=np.append(null, False)), pa.array(names.view(np.int64)))


def fingerprints(docs: DataFrame, levels: int = 5, finest: int = 3) -> DataFrame:
    """doc_id, whole, phrases, phrases_3, phrases_4: the names of the phrases of the top level in order, one name for their sequence,
    and the names of the levels below from ``finest`` on.

    Level 0 is the bytes of the text. At each level runs of one symbol are collapsed, deterministic coin tossing labels symbols
    by comparison with their neighbours, and local maxima of the labels cut the sequence into phrases of 2 to about 11
    symbols (a row's end may leave one), which are named by a hash of their content. What a phrase is called and where it is cut depends on a bounded
    neighbourhood only; so equal substrings have equal names but for a few phrases at either end, wherever they stand. Levels
    3, 4 and 5 make phrases of some 15, 35 and 85 bytes. A shared passage must be longer than the phrases at its ends to
    show: of 50 words all share names of levels 3 and 4, but only about 70 in 100 one of level 5. Equal texts have equal ``whole``.

    Empty text: no phrases and the whole name of nothing. Null text: null whole and phrases. A null doc_id is carried. Repeated
    rows: a result each. No documents: no rows. Other columns are ignored.
    """
    if not 1 <= finest <= levels:
        raise ValueError("finest must be at least 1 and at most levels")
    below = [f"phrases_{k}" for k in range(finest, levels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for at, end, raw, offsets in pieces(text):
                *finer, (names, _, of) = list(hierarchy(raw, offsets, levels))[finest - 1 :]
                n = np.diff(of)
                total = np.zeros(len(names) + 1, U64)
                nth = np.arange(len(names)) - np.repeat(of[:-1], n)
                np.cumsum(mix(names + nth.astype(U64) * _RUN), dtype=U64, out=total[1:])
                whole = mix(total[of[1:]] - total[of[:-1]] + n.astype(U64)).view(np.int64)
                null = text.slice(at, end - at).is_null().to_numpy(zero_copy_only=False)
                lists = [_lists(names, of, null), *[_lists(x, of_x, null) for x, _, of_x in finer]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(whole, mask=null), *lists], ["doc_id", "whole", "phrases", *below])

    schema = ", ".join(["doc_id long, whole long, phrases array<long>", *[f"{c} array<long>" for c in below]])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
