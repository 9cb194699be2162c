"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release, text_score
from .kernels import U64, WORD, mix, pieces, span_hashes, string_parts, sums, words

BITS = 16
PIECE = 1 << 18  # small, for a dozen arrays of its size are in use at a time
SAMPLE = 4000
CUT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*^~=<>{}[]\\_@+"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord(c) for c in "([{"]] = True
_CLOSE[[ord(c) for c in ")]}"]] = True
FUNCTION_WORDS = (
    "the of and to in is that it for was on with as be by at this are or an from und der die das den mit von zu ist nicht ein eine auf sich "
    "de la le les des et en un une que qui dans pour est par sur el los las y del se por con una para al"
)

# (measure, good from, good up to, bad from); else a labeller abstains. The last two only ever vote good: prose of a language they
# know, and brackets that match, as in code.
LABELLERS = (
    ("symbols", 0.0, 0.005, 0.15),  # share of bytes
    ("upper", 0.004, 0.12, 0.3),  # share of letters
    ("repeats", 0.0, 0.04, 0.15),  # share of words that repeat the one before
    ("bars", 0.0, 0.0, 0.2),  # table bars a word
    ("shouts", 0.0, 0.02, 0.1),  # exclamation marks a word
    ("run", 2.0, 24.0, 60.0),  # words a full stop
    ("sameness", 0.0, 0.35, 0.6),  # share of word pairs that occurred before in the text
    ("marked", 0.0, 0.01, 0.25),  # share of words that a doubled symbol or exclamation mark follows
    ("loose", 0.0, 0.03, 0.4),  # single marks between blanks a word
    ("function", 0.1, 1.0, np.inf),  # share of function words
    ("balance", 0.9, 1.0, np.inf),  # closing brackets an opening one, or the other way round
)
NAMES = tuple(x[0] for x in LABELLERS)
ACCUSERS = tuple(j for j, x in enumerate(LABELLERS) if np.isfinite(x[3]))


def _hashes(text: str) -> np.ndarray:
    raw, offsets = string_parts(pa.array([text]))
    starts, ends, _ = words(raw, offsets)
    return np.unique(span_hashes(raw, starts, ends))


_FUNCTION = _hashes(FUNCTION_WORDS)


def measures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, labellers) measures; nan where a text has too little to tell (fewer than five words, twenty for sameness, four brackets for balance)."""
    n_bytes = np.diff(offsets)
    starts, ends, first = words(raw, offsets)
    n_words = np.diff(first)
    h = span_hashes(raw, starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = np.zeros(len(h), U64)
    pair[:-1] = mix(h[:-1] * U64(3) + h[1:])[: len(h) - 1] if len(h) else pair[:-1]
    inner = np.ones(len(h), bool)
    inner[first[1:][n_words > 0] - 1] = False
    key = row[inner].astype(U64) << U64(54) | pair[inner] >> U64(10)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> U64(54)).astype(np.int64), minlength=len(n_words))
    blank = raw <= 32
    alone = np.zeros(len(raw), bool)
    if len(raw) > 2:
        alone[1:-1] = blank[:-2] & blank[2:] & ~blank[1:-1] & ~WORD[raw[1:-1]]
    symbol, bar, shout = _SYMBOL[raw], raw == ord("|"), raw == ord("!")
    letters = sums(_LETTER[raw], offsets)
    accented = np.zeros(len(raw), bool)
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E) & (raw[1:] >= 0x80)
    upper = sums(_UPPER[raw] | accented, offsets)
    doubled = np.zeros(len(raw) + 1, bool)
    doubled[:-2] = (symbol | shout)[:-1] & (raw[:-1] == raw[1:]) if len(raw) > 1 else False
    function = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, h), len(_FUNCTION) - 1)] == h
    opened, closed = sums(_OPEN[raw], offsets), sums(_CLOSE[raw], offsets)
    w = np.maximum(n_words, 1)
    out = np.column_stack(
        [
            sums(symbol, offsets) / np.maximum(n_bytes, 1),
            upper / np.maximum(letters, 1),
            sums(again, first) / w,
            sums(bar, offsets) / w,
            sums(shout, offsets) / w,
            n_words / (sums((raw == 46) | (raw == 63), offsets) + 1),
            1 - distinct / np.maximum(n_words - 1, 1),
            sums(doubled[ends], first) / w,
            sums(alone, offsets) / w,
            sums(function, first) / w,
            np.where(opened + closed >= 4, np.minimum(opened, closed) / np.maximum(np.maximum(opened, closed), 1), np.nan),
        ]
    )
    out[n_words < 5] = np.nan
    out[n_words < 20, NAMES.index("sameness")] = np.nan
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """0 for bad, 1 for abstaining, 2 for good."""
    low, high, bad = (np.array([x[i] for x in LABELLERS]) for i in (1, 2, 3))
    with np.errstate(invalid="ignore"):
        return np.where(m >= bad, 0, np.where((m >= low) & (m <= high), 2, 1)).astype(np.int8)


def codes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    """P(class), the first for good documents and one for each kind of bad ones, and P(bad or good vote | class, a vote) as (classes, labellers, 2)."""

    prior: np.ndarray
    table: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """P(class | votes); abstaining says nothing."""
        logs = np.log(self.prior) + (v == 0) @ np.log(self.table[:, :, 0]).T + (v == 2) @ np.log(self.table[:, :, 1]).T
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        return self.classes(v)[:, 0]


def expectation_maximisation(v: np.ndarray, count: np.ndarray, accusers: tuple[int, ...] = ACCUSERS, rounds: int = 500) -> LabelModel:
    """Fitted to vote patterns v with their counts.

    Bad documents are of as many kinds as there are labellers that can vote bad; each kind starts as what one of them
    mostly accuses and the others mostly pass, good documents as what all mostly pass. From there, how often each labeller accuses
    documents of each class is free: no rate is bounded, ten pseudo-votes a rate are all that the start weighs. With one bad
    class the likeliest two could be one kind of junk and all the rest.
    """
    pseudo = np.tile(np.array([0.5, 9.5]), (len(accusers) + 1, v.shape[1], 1))
    for k, j in enumerate(accusers):
        pseudo[k + 1, j] = 9.5, 0.5
    share = np.array([7.0, *[3.0 / max(1, len(accusers))] * len(accusers)])
    model = LabelModel(share / share.sum(), pseudo / pseudo.sum(2, keepdims=True))
    for _ in range(rounds):
        weight = model.classes(v) * count[:, None]
        table = pseudo + np.stack([weight.T @ (v == 0), weight.T @ (v == 2)], 2)
        new = LabelModel((weight.sum(0) + share) / (count.sum() + share.sum()), table / table.sum(2, keepdims=True))
        done = max(np.abs(new.prior - model.prior).max(), np.abs(new.table - model.table).max()) < 1e-7
        model = new
        if done:
            break
    return model


_BINS = (
    (0.0, 0.002, 0.004, 0.01, 0.02, 0.05, 0.1),
    (0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.6),
    (0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6),
    (0.0, 0.005, 0.01, 0.02, 0.1, 0.3, 0.6),
    (0.0, 0.005, 0.01, 0.03, 0.1, 0.3, 0.6),
    (6.0, 12.0, 24.0, 40.0, 60.0, 100.0, 200.0),
    (0.1, 0.25, 0.4, 0.6, 0.75, 0.85, 0.95),
    (0.0, 0.02, 0.1, 0.25, 0.5, 0.75, 0.9),
    (0.0, 0.01, 0.05, 0.15, 0.3, 0.6, 0.9),
    (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    (0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 0.99),
)


def hashed(raw: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers: of each byte triple (n - 2 a row), the rows' ranges of them, and of the binned measures (rows, labellers)."""
    x = raw.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D)) if len(x) > 2 else np.zeros(0, np.uint32)
    h ^= h >> np.uint32(15)
    triple = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    starts = np.minimum(offsets[:-1], len(triple))
    stops = np.clip(offsets[1:] - 2, starts, None)
    bins = np.column_stack([np.searchsorted(_BINS[j], np.nan_to_num(m[:, j], nan=-1.0), "left") + np.isnan(m[:, j]) * 8 for j in range(len(LABELLERS))])
    names = mix((bins + 16 * np.arange(len(LABELLERS))).astype(U64) + U64(77)) >> U64(64 - BITS)
    return triple, np.column_stack([starts, stops]), names.astype(np.int64)


def triple_means(value: np.ndarray, spans: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1)
    np.cumsum(value, out=total[1:])
    return (total[spans[:, 1]] - total[spans[:, 0]]) / np.maximum(spans[:, 1] - spans[:, 0], 1)


SCALE = 8.0  # of the mean triple weight against the measures'


def score(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    triple, spans, names = hashed(raw, offsets, measures(raw, offsets))
    return weights[-1] + SCALE * triple_means(weights[triple], spans) + weights[names].sum(1)


def train(texts: list[str], label_model: LabelModel, rounds: int = 120, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Weights of the hashed features and the bias, by logistic regression on the posterior labels (full batch, Adam)."""
    rows, cols, vals, labels, at = [], [], [], [], 0
    for _, _, raw, offsets in pieces(pa.array(texts, pa.string())):
        m = measures(raw, offsets)
        triple, spans, names = hashed(raw, offsets, m)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), spans[:, 1] - spans[:, 0])
        at_triple = np.concatenate([np.arange(a, b) for a, b in spans]) if len(row) else np.zeros(0, np.int64)
        key, c = np.unique(row << BITS | triple[at_triple], return_counts=True)
        r = key >> BITS
        rows += [x.astype(np.int32) for x in (r + at, np.repeat(np.arange(n), names.shape[1]) + at)]
        cols += [x.astype(np.int32) for x in (key & (1 << BITS) - 1, names.ravel())]
        vals += [x.astype(np.float32) for x in (SCALE * c / np.maximum(spans[:, 1] - spans[:, 0], 1)[r], np.ones(names.size))]
        labels.append(label_model.posterior(votes(m)))
        at += n
    w = np.zeros((1 << BITS) + 1)
    if not at:
        return w
    row, col, val, y = (np.concatenate(x) for x in (rows, cols, vals, labels))
    del rows, cols, vals
    order = np.argsort(row, kind="stable")  # by row for the scores, by column for the gradient: sums of adjacent entries
    row, col, val = row[order], col[order], val[order]
    of_row = np.searchsorted(row, np.arange(at))
    order = np.argsort(col, kind="stable")
    there, of_col = np.unique(col[order], return_index=True)
    row_by_col, val_by_col = row[order], val[order]
    del row, order
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.add.reduceat(val * w.astype(np.float32)[col], of_row) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = l2 * w
        g[there] += np.add.reduceat(val_by_col * error.astype(np.float32)[row_by_col], of_col) / at
        g[-1] += error.mean()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All vote patterns of the corpus and how many documents have each; at most 3 ** labellers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, raw, offsets in pieces(batch.column("text"), PIECE):
                total += np.bincount(codes(votes(measures(raw, offsets))), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    rows = map_batches(docs.where("octet_length(text) > 0").select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    code, count = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, count


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes on all documents, and the scorer, from about ``sample`` documents chosen by a seeded hash."""
    v, count = pattern_counts(docs)
    model = expectation_maximisation(v.reshape(-1, len(LABELLERS)), count)
    n = int(count.sum())
    share = min(1.0, sample / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.octet_length("text")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    texts = [r.text for r in docs.where("octet_length(text) > 0").where(draw).select("text").limit(2 * sample).toLocalIterator()]
    weights = train(texts, model)
    del texts
    release()
    return model, weights


def classify(docs: DataFrame, sample: int = SAMPLE, cut: float = CUT, columns: list[str] | None = None) -> DataFrame:
    """The documents that the classifier keeps: ``columns`` (doc_id alone, if not given) and score, the probability of good quality.

    Heuristic labellers vote good, bad or abstain on each document, over its whole text. Expectation-maximisation over the
    counts of all vote patterns of the corpus estimates how the labellers err and with that each document's posterior. On
    about ``sample`` documents (the documented bound: a fixed number whatever the corpus) the posteriors train a linear
    scorer over hashed byte triples and binned measures; it scores every document. Kept is what scores ``cut`` or more.

    Null and empty text: rejected. A null doc_id is carried. Short texts (fewer than five words) get votes from no labeller, so the
    prior and their triples decide. A text of any length is one row of one vote. Equal texts get equal scores, so repeated rows
    stay or go together. No documents: no rows. Other columns are ignored.
    """
    _, w = fit(docs, sample)
    weights = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # 256 KB, whatever the data
    columns = columns or ["doc_id"]
    rows = docs.select(*columns, F.col("text").alias("_loom_text")).where("octet_length(_loom_text) > 0")

    def probability(text: pa.Array) -> pa.Array:
        z = np.concatenate([score(raw, offsets, weights.value) for _, _, raw, offsets in pieces(text, PIECE)]) if len(text) else np.zeros(0)
        return pa.array((1 / (1 + np.exp(-np.clip(z, -30, 30)))).round(6), pa.float64())

    return text_score(rows, probability, "_loom_text", "score").where(F.col("score") >= cut).select(*columns, "score")
