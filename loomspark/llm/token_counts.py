"""Token counts of the sections of a document, from one encoding of the whole document."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .kernels import pieces

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")  # the white space of PATTERN


@lru_cache(2)
def tokenizer(path: str, pattern: str):
    """The encoding, and the bytes of each token. One a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """The tokens of a text.

    Under ``PATTERN`` a run of white space is one piece, but for its last character where something follows; the pattern's
    engine gives up on runs of some hundred thousand, so long ones are taken out and encoded as the pieces that they are. Other
    patterns have their own pieces: nothing is taken out for them.
    """
    encoding = tokenizer(path, pattern)[0]
    if pattern != PATTERN:
        return encoding.encode_ordinary

    def encode(text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += encoding.encode_ordinary(text[at : run.start()])
            out += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)

    return encode


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token [start, end), by the sorted section starts; the interval join, as two binary searches.

    A token over a boundary goes to the section of its first byte (``first``), of its last byte (``last``), or to the one that holds
    most of its bytes, the earliest of equals (``most``).
    """
    first = np.searchsorted(sections, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(sections, ends - 1, "right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        edges = [starts[i], *sections[first[i] + 1 : last[i] + 1], ends[i]]
        out[i] = first[i] + int(np.argmax(np.diff(edges)))
    return out


def count_tokens(docs: DataFrame, rule: str = "first", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, start, end, n_tokens: a row for each section (line) of each text.

    A section is a line with its newline; start and end are character offsets, section numbers count from 0. The whole text is
    encoded once by the byte-level BPE vocabulary in the file ``ranks`` (which every worker can read); the byte spans of
    its tokens follow from their lengths and are joined to the sections. Boundary-crossing tokens go by ``rule``, see
    ``allocate``; so the sections' counts add up to the document's.

    Empty text is one section without tokens. Long texts, words and runs of blanks are encoded whole. Null text: no row. A null doc_id is carried. Repeated rows: a result each. No
    documents: no rows. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(ranks, pattern), tokenizer(ranks, pattern)[1]
        for batch in batches:
            for at, end, raw, offsets in pieces(batch.column("text"), 1 << 22):
                tokens: list[int] = []
                for text in batch.column("text").slice(at, end - at).to_pylist():
                    tokens += encode(text)
                ends = np.cumsum(size[np.array(tokens, np.int64)])
                if (ends[-1] if len(ends) else 0) != len(raw):
                    raise ValueError("the vocabulary doesn't cover all bytes")
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                breaks = np.flatnonzero(raw == 10) + 1
                full = np.unique(np.concatenate([offsets[:-1], breaks[breaks < len(raw)]])) if len(raw) else np.zeros(0, np.int64)
                lengths = np.diff(offsets)
                # an empty text has a section of its own though it holds no byte
                full_rows = np.searchsorted(offsets[1:], full, "right")
                here = full < len(raw)
                full, full_rows = full[here], full_rows[here]
                counts = np.bincount(allocate(starts, ends, full, rule), minlength=len(full)) if len(ends) else np.zeros(len(full), np.int64)
                empty = np.flatnonzero(lengths == 0)
                row = np.concatenate([full_rows, empty])
                begin = np.concatenate([full, offsets[empty]])
                stop = np.concatenate([full[1:], [len(raw)], offsets[empty]]) if len(full) else offsets[empty]
                n = np.concatenate([counts, np.zeros(len(empty), np.int64)])
                order = np.lexsort((begin, row))
                row, begin, stop, n = row[order], begin[order], stop[order], n[order]
                chars = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
                base = chars[offsets[row]]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                ids = batch.column("doc_id").slice(at, end - at).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(nth.astype(np.int32)), pa.array(chars[begin] - base), pa.array(chars[stop] - base), pa.array(n.astype(np.int32))], ["doc_id", "section", "start", "end", "n_tokens"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, section int, start long, end long, n_tokens int")


def document_tokens(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens: the exact token count of each text, a row for each row of docs.

    Null text: null. Empty text: 0. A null doc_id is carried. Repeated rows: a result each. No documents: no rows. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        for batch in batches:
            n = [None if text is None else len(encode(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long")
