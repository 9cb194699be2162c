"""Text functions as columns. Offsets are in characters. Only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..workers import by_slices

LETTER_START = r"\p{L}[\p{L}\p{Mn}\p{Nd}_'\-]*"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
MARKS = r"[\p{P}\p{S}]+"
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "inc.", "ltd.", "e.g.", "i.e.", "vs.")
STOPWORDS = "the a an and or to of in on for is are was were".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text, pattern: str = LETTER_START) -> Column:
    """All matches of a token pattern, in order."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def lower_words(text, pattern: str = LETTER_START) -> Column:
    return words(F.lower(_col(text)), pattern)


def pieces(text) -> Column:
    """Runs of non-blank characters."""
    return words(text, r"\S+")


def regex_tokens(text, pattern: str = r"[\p{L}\p{N}_\-]+") -> Column:
    return words(text, pattern)


def sentences(text, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Cut at blanks after . ! or ?, but not after an abbreviation."""
    ends = "|".join(a.replace(".", r"\.") for a in abbreviations)
    t = F.trim(_col(text))
    if ends:
        t = F.regexp_replace(t, rf"(?i)({ends})\s+", "$1\x01")
    parts = F.split(t, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\x01", " "))), lambda s: s != "")


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def title(text) -> Column:
    return F.initcap(_col(text))


def remove_emoji(text) -> Column:
    return F.regexp_replace(_col(text), EMOJI, "")


def keep_emoji(text) -> Column:
    return F.array_join(F.regexp_extract_all(_col(text), F.lit(EMOJI), F.lit(0)), "")


def remove_punctuation(text) -> Column:
    return F.regexp_replace(_col(text), MARKS, " ")


def keep_punctuation(text) -> Column:
    return F.array_join(F.regexp_extract_all(_col(text), F.lit(MARKS), F.lit(0)), "")


def normalize_unicode(text, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form}")
    return by_slices(lambda texts: pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts], pa.string()), "string", _col(text))


_MARKS = regex.compile(r"\p{Mn}+")


def plain(t: str) -> str:
    """Without accents: decomposed, marks dropped, composed."""
    if t.isascii():
        return t
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", t)))


def strip_accents(text) -> Column:
    return by_slices(lambda texts: pa.array([None if t is None else plain(t) for t in texts], pa.string()), "string", _col(text))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(_col(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ngrams_of(tokens: Column, n: int) -> Column:
    """Joined by a blank; the tokens themselves if n <= 1 or there are fewer than n."""
    if n <= 1:
        return tokens
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) < n, tokens).otherwise(grams)


def ngrams(text, n: int = 2) -> Column:
    return ngrams_of(words(text), n)


def initials(text, most: int = 6) -> Column:
    return F.array_join(F.transform(F.slice(words(text), 1, most), lambda w: F.upper(F.substring(w, 1, 1))), "")


def jaccard(a, b, empty: float = 0.0) -> Column:
    """Of two arrays as sets; ``empty`` where both are empty."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, float(empty)).otherwise(F.size(F.array_intersect(_col(a), _col(b))) / F.nullif(union, F.lit(0)))


def levenshtein_similarity(a, b) -> Column:
    """1 - distance / longer length, in characters; 1 for two empty strings."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


# written apart from each other so that each dialect can have its own: these hold for Java and RE2 alike
EMAIL = r"\b[A-Za-z\d._%+-]+@[A-Za-z\d.-]+\.[a-zA-Z]{2}[a-zA-Z]*\b"
PHONE = r"\b\+?\d[\d\s().-]{7,}\d\b"
URL = r"\bhttps?://[^<>\"\s]+"
CARD = r"\b\d(?:[ -]*\d){12,18}\b"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def redact_pii(text, email: str = "[EMAIL]", phone: str = "[PHONE]", url: str = "[URL]", card: str = "[CARD]") -> Column:
    """Mail addresses, phone numbers, links, then card numbers with a valid check digit; each step sees what the ones before left."""
    t = _col(text)
    for pattern, mask in ((EMAIL, email), (PHONE, phone), (URL, url)):
        t = F.regexp_replace(t, pattern, mask)
    hits = F.array_distinct(F.regexp_extract_all(t, F.lit(CARD), F.lit(0)))
    valid = F.filter(hits, lambda h: _luhn(F.regexp_replace(h, r"\D+", "")))
    return F.aggregate(valid, t, lambda s, h: F.replace(s, h, F.lit(card)))


def _close_to(term: str, distance: int):
    return lambda w: (w != "") & (F.levenshtein(w, F.lit(term), distance) >= 0)


def find_terms(text, terms: list[str], fuzzy: bool = False, distance: int = 1) -> Column:
    """Those of terms that occur in the text, or (fuzzy) are within an edit distance of one of its words."""
    low = F.lower(_col(text))
    ws = F.array_distinct(F.split(low, r"[^\p{L}\p{N}_]+"))
    found = []
    for term in dict.fromkeys(terms):
        hit = F.contains(low, F.lit(term.lower()))
        if fuzzy:
            hit = hit | F.exists(ws, _close_to(term.lower(), distance))
        found.append(F.when(hit, F.lit(term)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def redact_terms(text, terms: list[str], mask: str = "[SENSITIVE]") -> Column:
    """Whole-word occurrences of the terms, whatever the case."""
    import re

    t = _col(text)
    for term in terms:
        t = F.regexp_replace(t, rf"(?i)\b{re.escape(term)}\b", mask)
    return t
