"""Redaction of personal data: overlapping candidate spans, boosted trees, calibrated thresholds."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID")
EMAIL = [r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]+)+"]
NUMERIC = {
    "PHONE": [
        r"(?<![\w+])\+?\d{0,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)",
        r"(?<![\w.])0\d{1,4}(?:[ /.-]\d{2,4}){1,4}(?!\d)",
    ],
    "CARD": [r"(?<!\d)\d{12,19}(?!\d)", r"(?<!\d)\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}(?!\d)", r"(?<!\d)3\d{3}[ -]\d{6}[ -]\d{5}(?!\d)"],
    "IP": [r"(?<![\d.])\d{1,4}(?:\.\d{1,4}){3}(?!\.?\d)"],
    "ID": [r"(?<![\d-])\d{3}[ -]\d{2}[ -]\d{4}(?![\d-])"],
}
RUNS = [
    r"(?<![A-Za-z0-9])[A-Z]{2,5}[A-Z0-9]{14,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{2,12}[_-][A-Za-z0-9]{20,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{16,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])",
]
NAMED = [r"(?i:(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([^\s\"']{6,})"]
COLONS = [r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])"]
BANK = [r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"]


def _compiled(kind: str, patterns: list[str]) -> list[tuple[int, re.Pattern]]:
    return [(KINDS.index(kind), re.compile(p)) for p in patterns]


_EMAIL, _RUNS, _NAMED, _COLONS, _BANK = _compiled("EMAIL", EMAIL), _compiled("SECRET", RUNS), _compiled("SECRET", NAMED), _compiled("IP", COLONS), _compiled("ID", BANK)
_NUMERIC = [x for kind, patterns in NUMERIC.items() for x in _compiled(kind, patterns)]
GENERATORS = [*_EMAIL, *_NUMERIC, *_RUNS, *_NAMED, *_COLONS, *_BANK]
_DIGITS, _RUN = re.compile(r"\d++"), re.compile(r"[A-Za-z0-9+/_-]{16,}+")
GAP = 4  # the digits of a numeric candidate are at most three other characters apart
ANY = r"[\p{Nd}@=:]"  # every candidate has one of these, or is a long run of letters
LONG = "[A-Za-z+/_-]{16}"
_CONTEXT = [
    re.compile(p, re.I)
    for p in (
        r"e-?mail|write to|contact",
        r"phone|\btel|call|mobile|fax|whatsapp",
        r"card|visa|master|amex|payment|credit",
        r"\bip\b|address|host|server|login from",
        r"token|passw|pwd|secret|api|\bkey|auth|credential",
        r"ssn|social|passport|iban|account",
        r"version|\bv\.?$|release|build|section|chapter|\bfig",
        r"order|invoice|isbn|item|sku|ref|ticket|serial|tracking|batch|part",
        r"commit|hash|sha|md5|digest|checksum|uuid|revision",
        r"[$€£]\s*$|price|total|usd|eur|population|distance|since|year|page",
    )
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _windows(text: str) -> list[tuple[int, int]]:
    """Where numeric candidates can be: runs of digits at most ``GAP`` apart, with as much around them."""
    out: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        a, b = m.start() - GAP, m.end() + GAP
        if out and a - GAP <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((max(0, a), b))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), distinct; spans of different generators may overlap.

    Each generator looks only where what it needs is; that finds what it would find in the whole text, in time that is linear in it.
    """
    jobs = [(_EMAIL, 0, len(text))] if "@" in text else []
    windows = _windows(text)
    jobs += [(_NUMERIC, a, b) for a, b in windows]
    jobs += [(_RUNS, m.start(), m.end() + 3) for m in _RUN.finditer(text)]
    if ":" in text or "=" in text:
        jobs.append((_NAMED, 0, len(text)))
        if text.count(":") >= 3:
            jobs.append((_COLONS, 0, len(text)))
    if windows:
        jobs.append((_BANK, 0, len(text)))
    return sorted({(*(m.span(1) if p.groups else m.span()), kind) for generators, a, b in jobs for kind, p in generators for m in p.finditer(text, a, min(b, len(text)))})


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = [c for c in s if c.isalpha()]
    counts = Counter(s)
    before, after = text[max(0, start - 28) : start], text[end : end + 2]
    numbers = re.findall(r"\d+", s)
    octets = len(numbers) == 4 and s.count(".") == 3 and all(len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in numbers)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(n),
        float(len(digits)),
        len(digits) / n,
        len(letters) / n,
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        changes / n,
        float(len(digits) >= 12 and luhn(digits)),
        float(octets),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        float(len(numbers)),
        float(max(map(len, numbers), default=0)),
        float(min(map(len, numbers), default=0)),
        float(s[:1] == "+"),
        float("(" in s and ")" in s),
        float(s.count(".")),
        float(s.count("-")),
        float(s.count(" ")),
        float(bool(re.search(r"\.[A-Za-z]{2,12}$", s))),
        float(bool(re.match(r"(AKIA|ASIA|ghp_|gho_|sk-|sk_|xox[abp]-|AIza|glpat-)", s))),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(digits[:2] in ("19", "20")),
        float(before[-1:].isalnum()),
        float(before[-1:] in ("=", ":", '"', "'")),
        float(after[:1].isalnum()),
        float(before[-1:] in ("$", "€", "£", "#", "v", "-", "/")),
        *[float(bool(c.search(before))) for c in _CONTEXT],
    ]


def synthetic(n: int, seed: int) -> tuple[list[tuple[str, int, int, int]], np.ndarray]:
    """n labelled sentences at least: candidates in made-up text, and whether each is personal data or a secret.

    Positives have the public formats (example mail hosts, numbers with a valid check digit, addresses in range, key
    shapes); negatives are look-alikes: versions, dates, prices, serial and order numbers, digests, identifiers in code.
    """
    r = random.Random(seed)
    pick = r.choice
    word = lambda: "".join(pick(("th", "er", "on", "an", "re", "in", "ed", "st", "es", "ou", "ä", "é", "ción", "ung")) for _ in range(r.randint(1, 4)))
    digit = lambda k: "".join(pick("0123456789") for _ in range(k))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def checked(good: bool) -> str:
        body = pick("3456") + digit(r.choice((14, 14, 14, 13)))
        last = next(d for d in "0123456789" if luhn(body + d))
        if not good:
            last = pick([d for d in "0123456789" if d != last])
        return body + last

    def spaced(s: str) -> str:
        sep = pick(("", "", " ", "-"))
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    area = lambda: pick("123456789") + digit(2)
    lead = ("", "", "", "", "")
    positive = [
        (0, lambda: f"{word()}{pick(('.', '_', '', '+'))}{digit(r.randint(0, 3))}@{pick(('mail', 'post', 'web'))}{digit(r.randint(0, 1))}.{pick(('example', word()))}.{pick(('com', 'org', 'net', 'de', 'fr', 'io'))}".replace("ä", "a").replace("é", "e"), (*lead, "email ", "contact: ")),
        (1, lambda: pick((f"+1 ({area()}) {digit(3)}-{digit(4)}", f"({area()}) {digit(3)}-{digit(4)}", f"+1-{area()}-{digit(3)}-{digit(4)}", f"{area()}-{digit(3)}-{digit(4)}", f"+49 {digit(3)} {digit(7)}", f"+33 {digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}")), (*lead, "call ", "Tel. ", "phone: ")),
        (2, lambda: spaced(checked(True)), (*lead, "card ", "Visa ")),
        (3, lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), (*lead, "ip ", "from host ")),
        (4, lambda: pick((hexa(40), hexa(18), hexa(32), hexa(24), some(mixed, 16), some(mixed, 12) + "!")), ('token = "', "password=", "password: ", "api_key=", 'secret = "', "auth: ", 'TOKEN = "', "pwd=")),
        (4, lambda: pick(("AKIA" + some(upper, 16), "ASIA" + some(upper, 16), "ghp_" + some(mixed, 36), "sk-" + some(mixed, 32), "AIza" + some(mixed, 35))), (*lead, "key ")),
        (5, lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", (*lead[:2], "SSN ", "social security ")),
        (5, lambda: pick(("DE", "FR", "ES", "GB")) + digit(2) + "".join(pick((" ", "")) + digit(4) for _ in range(4)) + digit(2), (*lead, "IBAN ")),
    ]
    negative = [
        (lambda: f"{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 20)}.{r.randint(256, 4000)}", ("version ", "build ", "v", "release ")),
        (lambda: ".".join(str(r.randint(300, 999)) for _ in range(4)), lead),
        (lambda: f"{r.randint(1, 12)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", ("version ", "section ", "v", "release ")),
        (lambda: checked(False), ("order ", "serial ", "tracking no ", "item ", *lead)),
        (lambda: digit(pick((12, 13, 14, 17, 18, 19))), ("order ", "ISBN ", "ref ", "population ", *lead)),
        (lambda: f"978{digit(10)}", ("ISBN ", *lead)),
        (lambda: f"20{digit(2)}{digit(4)}{digit(6)}", ("since ", "batch ", *lead)),
        (lambda: f"{digit(3)} {digit(3)} {digit(4)}", ("population ", "total ", "$ ", "part ")),
        (lambda: digit(10), ("order ", "item ", "ref ", "since ", "year ", *lead)),
        (lambda: f"0{digit(1)}/{digit(2)}/{digit(4)}", ("since ", *lead)),
        (lambda: f"0{digit(1)}.{digit(2)}.{digit(4)}", ("", "page ")),
        (lambda: hexa(40), ("commit ", "sha1 ", "digest ", "revision ", *lead)),
        (lambda: hexa(pick((32, 64, 16))), ("md5 ", "checksum ", "hash: ", *lead)),
        (lambda: "".join(word().capitalize() for _ in range(9)).replace("ä", "a").replace("é", "e").replace("ó", "o"), lead),
        (lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r.randint(17, 30)), lead),
        (lambda: "-".join(word() for _ in range(6)), lead),
        (lambda: pick(("required", "forgotten", "changeme-please", "expired", "protected", "authentication")), ("password: ", "token: ", "secret: ")),
        (lambda: f"{word()}@{digit(1)}.{digit(1)}.{digit(1)}", ("npm ", "release ")),
        (lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(4)} {digit(4)}", ("", "batch ", "serial ")),
        (lambda: ":".join(digit(2) for _ in range(4)), lead),
    ]
    rows: list[tuple[str, int, int, int]] = []
    labels: list[bool] = []
    while len(rows) < n:
        good = r.random() < 0.5
        if good:
            kind, make, leads = pick(positive)
        else:
            (make, leads), kind = pick(negative), -1
        body = make()
        left = " ".join(word() for _ in range(r.randint(1, 6))) + " " + pick(leads)
        right = pick(("", '"' if left.endswith('"') else "", ".", ",", "***", "$$$", "!!", " ")) + " " + " ".join(word() for _ in range(3))
        text, at = left + body + right, len(left)
        for a, b, k in candidates(text):
            if b > at and a < at + len(body):
                rows.append((text, a, b, k))
                # right if it is the kind meant and covers it; the value of a hex secret is one under either generator
                labels.append(good and k == kind and a <= at + (1 if kind == 1 else 0) and b >= at + len(body.rstrip("!")))
    return rows, np.array(labels)


@dataclass
class Trees:
    """Gradient-boosted trees of depth 3 on binned features, for log loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    DEPTH = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, width = self.binned(x), bins + 1
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split_by, split_at = np.zeros(2**self.DEPTH - 1, np.int64), np.full(2**self.DEPTH - 1, width)
            for depth in range(self.DEPTH):
                first, n = 2**depth - 1, 2**depth
                best = np.full(n, 1e-6)
                for j in range(x.shape[1]):
                    key = (node - first) * width + b[:, j]
                    gs, hs = (np.bincount(key, v, n * width).reshape(n, width).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(n), at] > best
                    best[better] = gain[np.arange(n), at][better]
                    split_by[first : first + n][better], split_at[first : first + n][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), split_by[node]] > split_at[node])
            leaf = node - (2**self.DEPTH - 1)
            value = -rate * np.bincount(leaf, g, 2**self.DEPTH) / (np.bincount(leaf, h, 2**self.DEPTH) + l2)
            self.trees.append((split_by, split_at, value))
            z += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for split_by, split_at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                node = 2 * node + 1 + (b[rows, split_by[node]] > split_at[node])
            z += value[node - (2**self.DEPTH - 1)]
        return z


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    thresholds: np.ndarray  # by kind, of calibrated probability

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.offset, -30, 30)))


def fit(n: int = 8000, seed: int = 11, precision: float = 0.98, least: float = 0.5) -> Model:
    """Trees on two thirds of n synthetic candidates; on the rest, Platt's calibration and, by kind, the least threshold that reaches ``precision``.

    What is likelier not to be personal data, of a calibrated probability below ``least``, is never chosen.
    """
    rows, y = synthetic(n, seed)
    x = np.array([features(*r) for r in rows])
    kind = np.array([r[3] for r in rows])
    text_no = np.unique([r[0] for r in rows], return_inverse=True)[1]
    held = text_no % 3 == 0
    trees = Trees().fit(x[~held], y[~held].astype(float))
    z, t = trees.margin(x[held]), y[held]
    target = np.where(t, (t.sum() + 1) / (t.sum() + 2), 1 / ((~t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        e, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(e * z).mean(), e.mean()])
        hess = np.array([[(h * z * z).mean() + 1e-6, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    model = Model(trees, a, b, np.full(len(KINDS), least))
    p = model.probability(x[held])
    for k in range(len(KINDS)):
        mine = kind[held] == k
        if mine.any():
            order = np.argsort(-p[mine])
            right = np.cumsum(t[mine][order]) / np.arange(1, mine.sum() + 1)
            good = np.flatnonzero(right >= precision)
            if len(good) and good[-1] + 1 < mine.sum():  # else all candidates together are precise enough
                model.thresholds[k] = max(least, p[mine][order][good[-1]] - 1e-6)
    return model


def chosen(found: list[tuple[int, int, int]], p: list[float], thresholds: np.ndarray) -> list[tuple[int, int, str, float]]:
    """Of the candidates that reach their threshold: of overlapping ones the most probable, then the longest, then the first. By start."""
    starts: list[int] = []
    out: list[tuple[int, int, str, float]] = []
    for i in sorted(range(len(found)), key=lambda i: (-round(p[i], 6), found[i][0] - found[i][1], found[i])):
        start, end, kind = found[i]
        at = bisect_left(starts, start)
        if p[i] >= thresholds[kind] and (at == len(out) or out[at][0] >= end) and (not at or out[at - 1][1] <= start):
            starts.insert(at, start)
            out.insert(at, (start, end, KINDS[kind], round(p[i], 6)))
    return out


def select_all(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """The spans to redact of each text, by start; the candidates of all texts are scored at once."""
    found = [candidates(text) for text in texts]
    rows = [features(text, *c) for text, cs in zip(texts, found) for c in cs]
    p = model.probability(np.array(rows)).tolist() if rows else []
    out, at = [], 0
    for cs in found:
        out.append(chosen(cs, p[at : at + len(cs)], model.thresholds))
        at += len(cs)
    return out


def select(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """The spans to redact, by start."""
    return select_all([text], model)[0]


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, n_train: int = 8000, seed: int = 11, precision: float = 0.98) -> DataFrame:
    """doc_id, n_redactions, spans (start, end, kind, p; character offsets) and the redacted text, for each document with a redaction.

    Generators of high recall propose spans, which may overlap: mail addresses, phone and card numbers, network addresses, secrets,
    identity and bank numbers. Boosted trees over each span's format and the text around it, fitted to ``n_train`` synthetic
    candidates with a fixed seed and calibrated on a held-out third, give it a probability; thresholds by kind, set for
    ``precision``, select. Documents without a redaction stay as they are and have no row.

    Null and empty text: no row. A null doc_id is carried. Repeated rows: a result each. Equal probabilities go by length, then
    start. Work is linear in a text's length, whatever stands in it. Digits of any script count. No documents: no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(n_train, seed, precision))  # some KB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("p", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                given = part.column("text").to_pylist()
                found = zip(part.column("doc_id").to_pylist(), given, select_all(given, model.value))
                rows = [(doc_id, len(spans), [dict(zip(("start", "end", "kind", "p"), s)) for s in spans], redacted(text, spans)) for doc_id, text, spans in found if spans]
                if not rows:
                    continue
                ids, n, spans, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(spans, kind), pa.array(texts, pa.string())], ["doc_id", "n_redactions", "spans", "text"])

    some = docs.where(F.col("text").rlike(f"{ANY}|{LONG}")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(some, run, "doc_id long, n_redactions int, spans array<struct<start:int,end:int,kind:string,p:double>>, text string")
