"""Document explorer: sources, chunks, structured queries, summaries and multi-part questions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R
from .nlp import NerTagger, per_text

SOURCE_SCHEMA = "doc_id string, text string, source string, tag string, date string"


@dataclass
class Parsed:
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    near: list[tuple[str, str, int]] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)
    strict: bool = False
    search_query: str = ""


_FIELD = re.compile(r"\b(source|tag|docId|doc):(\S+)", re.I)
_DATES = re.compile(r"\bdate:(\d{4}-\d\d)\.\.(\d{4}-\d\d)\b", re.I)
_NEAR = re.compile(r'near\(([^,]+),\s*"([^"]+)",\s*window\s*=\s*(\d+)\)', re.I)
_PHRASE = re.compile(r'(?:\bphrase\s+)?"([^"]+)"', re.I)


def parse_query(query: str) -> Parsed:
    """source: tag: doc: date:YYYY-MM..YYYY-MM near(a, "b", window=n) "phrase" AND OR NOT terms."""
    p = Parsed()
    q = query.strip()
    for name, value in _FIELD.findall(q):
        p.filters[{"doc": "doc_id", "docid": "doc_id"}.get(name.lower(), name.lower())] = value
    q = _FIELD.sub(" ", q)
    if m := _DATES.search(q):
        p.filters |= {"date_from": m[1], "date_to": m[2]}
        q = _DATES.sub(" ", q)
    p.near = [(a.strip(" '\"").lower(), b.strip().lower(), max(1, int(n))) for a, b, n in _NEAR.findall(q)]
    q = _NEAR.sub(" ", q)
    phrases = [x.strip().lower() for x in _PHRASE.findall(q) if x.strip()]
    q = _PHRASE.sub(" ", q)
    operator, negate = "AND", False
    for part in q.split():
        if part.upper() in ("AND", "OR"):
            operator = part.upper()
        elif part.upper() == "NOT":
            negate = True
        elif term := regex.sub(r"[^\p{L}\p{N}_\-]+", "", part).lower():
            (p.must_not if negate else p.should if operator == "OR" else p.must).append(term)
            negate = False
    p.must, p.should, p.must_not, p.phrases = (list(dict.fromkeys(x)) for x in (p.must, p.should, p.must_not, phrases))
    p.strict = bool(p.filters or p.phrases or p.near or re.search(r"\b(AND|OR|NOT)\b", query, re.I))
    terms = [*p.must, *p.should, *p.phrases, *(x for n in p.near for x in n[:2])]
    p.search_query = " ".join(dict.fromkeys(t for t in terms if t))
    return p


def near(text: Column, a: str, b: str, window: int) -> Column:
    """Whether the least distance of occurrences of a and b, between where they begin, is within max(window, round(1.8 window)).

    One pattern each way; the distance from the start of one to the start of the other bounds what may lie between.
    """
    if not a.strip() or not b.strip():
        return F.lit(False)
    reach = max(window, int(window * 1.8 + 0.5))

    def ahead(x: str, y: str) -> str:
        return rf"(?s)(?={re.escape(x)}).{{0,{reach}}}?(?={re.escape(y)})"

    low = F.lower(text)
    return low.rlike(ahead(a, b)) | low.rlike(ahead(b, a))


def constraint(p: Parsed, text: str = "text") -> Column:
    """What a chunk must satisfy; nothing, unless the query is strict."""
    if not p.strict:
        return F.lit(True)
    low = F.lower(F.col(text))
    has = lambda t: F.contains(low, F.lit(t))
    out = F.lit(True)
    for t in (*p.phrases, *p.must):
        out = out & has(t)
    for t in p.must_not:
        out = out & ~has(t)
    if p.should:
        any_of = F.lit(False)
        for t in p.should:
            any_of = any_of | has(t)
        out = out & any_of
    for a, b, w in p.near:
        out = out & near(F.col(text), a, b, w)
    return out


def boost(p: Parsed, text: str = "text") -> Column:
    if not p.strict:
        return F.lit(0.0)
    low = F.lower(F.col(text))
    out = F.lit(0.0)
    for ts, by in ((p.phrases, 0.2), (p.must, 0.05), (p.should, 0.03)):
        for t in ts:
            out = out + F.when(F.contains(low, F.lit(t)), by).otherwise(0.0)
    for a, b, w in p.near:
        out = out + F.when(near(F.col(text), a, b, w), 0.25).otherwise(0.0)
    return out


def matches(filters: dict[str, str]) -> Column:
    out = F.lit(True)
    month = F.substring("date", 1, 7)
    for k, v in filters.items():
        if k in ("date_from", "date_to"):
            ok = (month >= v) if k == "date_from" else (month <= v)
            out = out & F.coalesce(ok & (F.col("date") != ""), F.lit(False))
        else:
            out = out & F.coalesce(F.col(k).cast("string") == v, F.lit(False))
    return out


def intent(query: Column | str) -> Column:
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    has = lambda t: F.contains(q, F.lit(t))
    return F.when(has("countries mentioned"), "ENTITY_COUNTRY").when(has("glossary"), "GLOSSARY").when(has("summarize") | has("summary"), "SUMMARY").otherwise("SEARCH")


_ASKS = re.compile(r"(what|where|when|how|which|who|is|are|does|do)\b", re.I)


def split_questions(prompt: str, most: int = 5) -> list[str]:
    """At ? ; and line ends, and at 'and' before a question word."""
    out: list[str] = []
    for piece in re.split(r"[?;\n]+", prompt):
        carry = ""
        for i, seg in enumerate(s.strip() for s in re.split(r"\s+and\s+", piece.strip(), flags=re.I)):
            if i and _ASKS.match(seg):
                out.append(carry)
                carry = seg
            elif seg:
                carry = f"{carry} and {seg}" if i else seg
        out.append(carry)
    return [x.strip() for x in out if x.strip()][:most]


def sentence_scores(texts: DataFrame, query: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, nth, sentence, score: the share of the query's distinct words that each sentence has."""
    q = list(dict.fromkeys(regex.findall(T.LETTER_START, query.lower())))
    qs = F.array(*[F.lit(t) for t in q]).cast("array<string>")
    s = texts.select(*keys, F.posexplode(T.sentences(text)).alias("nth", "sentence"))
    return s.withColumn("score", F.size(F.array_intersect(qs, T.lower_words("sentence"))) / max(1, len(q)))


def glossary_terms(docs: DataFrame, top: int = 12, text: str = "text", least: int = 4) -> DataFrame:
    """term, n: the most frequent words of at least four characters."""
    w = docs.select(F.explode(T.lower_words(text)).alias("term")).where(F.length("term") >= least)
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(max(1, top))


def regex_matches(docs: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """key, nth, start, end, match of all matches of a pattern in each text, with offsets in characters."""
    sought = regex.compile(pattern)
    return per_text(docs, key, text, lambda t: [(i, *m.span(), m[0]) for i, m in enumerate(sought.finditer(t))], "nth int, start int, end int, match string")


def format_table(rows: list[dict]) -> str:
    """Rows as a table of text, with the columns of the first."""
    if not rows:
        return "(empty)"
    names = list(rows[0])
    cells = [names, ["---"] * len(names), *[["" if r.get(n) is None else str(r[n]) for n in names] for r in rows]]
    return "\n".join(" | ".join(c) for c in cells)


def format_citations(hits: list[dict]) -> str:
    """doc_id:start-end of each hit."""
    return ", ".join(f"{h['doc_id']}:{int(h['start'])}-{int(h['end'])}" for h in hits) or "No citations."


class Explorer:
    """Sources and chunks as DataFrames; changed documents replace their chunks only."""

    def __init__(self, spark: SparkSession, size: int = 450, overlap: int = 80, tagger: NerTagger | None = None):
        self.spark, self.size, self.overlap = spark, max(100, size), overlap
        self.tagger = tagger or NerTagger()
        self.sources = spark.createDataFrame([], SOURCE_SCHEMA)
        self._chunks: DataFrame | None = None
        self._entities: DataFrame | None = None
        self._dirty: set[str] = set()

    def add(self, docs: DataFrame):
        """Sources with doc_id, text and, if there are, source, tag, date; replaces those of the same doc_id."""
        new = docs.select(*[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in self.sources.columns])
        self.sources = self.sources.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)
        self._chunks = None
        return self

    def add_text(self, doc_id: str, text: str, **meta: str):
        row = (doc_id, text, meta.get("source"), meta.get("tag"), meta.get("date"))
        new = self.spark.createDataFrame([row], SOURCE_SCHEMA)
        self.sources = self.sources.where(F.col("doc_id") != doc_id).unionByName(new)
        self._dirty.add(doc_id)
        return self

    def remove(self, doc_id: str):
        self.sources = self.sources.where(F.col("doc_id") != doc_id)
        self._dirty.add(doc_id)
        return self

    def _chunk(self, sources: DataFrame) -> DataFrame:
        size = self.size
        cut = R.split_text(sources, "doc_id", "text", size, min(self.overlap, size - 1), trim=False, keep=("source", "tag", "date"))
        return cut.where("trim(text) <> ''").select("doc_id", "id", "chunk", "start", (F.col("start") + F.length("text")).alias("end"), "text", "source", "tag", "date")

    @property
    def chunks(self) -> DataFrame:
        if self._chunks is None or self._dirty:
            self._entities = None
        if self._chunks is None:
            self._chunks = self._chunk(self.sources)
        elif self._dirty:
            changed = F.col("doc_id").isin(sorted(self._dirty))
            self._chunks = self._chunks.where(~changed).unionByName(self._chunk(self.sources.where(changed)))
        self._dirty = set()
        return self._chunks

    def stats(self) -> DataFrame:
        return self.sources.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))

    def search(self, query: str, k: int = 5, filters: dict[str, str] | None = None) -> DataFrame:
        """The k best chunks: BM25 takes 10 k, then filters, constraints and boosts decide."""
        p = parse_query(query)
        wanted = p.filters | (filters or {})
        scored = R.bm25_scores(self.chunks, p.search_query if p.strict and p.search_query else query)
        top = scored.orderBy(F.desc("score"), "doc_id", "chunk").limit(max(1, 10 * k))
        left = top.where(matches(wanted) & constraint(p)).withColumn("score", F.col("score") + boost(p))
        return left.orderBy(F.desc("score"), "doc_id", "chunk").limit(max(1, k))

    def fetch(self, doc_id: str, start: int = 0, end: int | None = None) -> DataFrame:
        text = F.col("text") if end is None else F.substr("text", F.lit(start + 1), F.lit(max(0, end - start)))
        return self.sources.where(F.col("doc_id") == doc_id).select("doc_id", text.alias("text"))

    def regex(self, pattern: str, limit: int = 50) -> DataFrame:
        """doc_id, nth, start, end, match of the first ``limit`` matches, with offsets in characters."""
        return regex_matches(self.sources, "doc_id", pattern).orderBy("doc_id", "nth").limit(limit)

    def entities(self, labels: list[str] | None = None) -> DataFrame:
        """Entities of all chunks with offsets in the document, each once. A loaded index has them, until its sources change."""
        c = self.chunks
        if self._entities is None:
            found = self.tagger.extract(c, "id").join(c.select("id", "doc_id", F.col("start").alias("_at")), "id")
            out = found.select("doc_id", "entity", "label", (F.col("start") + F.col("_at")).alias("start"), (F.col("end") + F.col("_at")).alias("end"), "confidence")
            out = out.dropDuplicates(["doc_id", "label", "start", "end"])
        else:
            out = self._entities
        return out.where(F.col("label").isin(labels)) if labels else out

    def summarize(self, query: str, sentences: int = 3, k: int = 5) -> DataFrame:
        """doc_id, sentence, score: of the k best chunks the sentences that share most words with the query."""
        hits = self.search(query, k)
        s = sentence_scores(hits, query, ["doc_id", "chunk"])
        return s.orderBy(F.desc("score"), "doc_id", "chunk", "nth").limit(max(1, sentences)).select("doc_id", "sentence", "score")

    def glossary(self, top: int = 12) -> DataFrame:
        return glossary_terms(self.sources, top)

    def query(self, prompt: str, k: int = 6, redact: bool = True) -> dict:
        """answer, citations and intent for one prompt; k rows reach the driver."""
        kind = self.spark.range(1).select(intent(F.lit(prompt)).alias("i")).first().i if prompt.strip() else "NONE"
        citations: list[dict] = []
        if kind == "NONE":
            answer = "No query provided."
        elif kind == "ENTITY_COUNTRY":
            names = [r.entity for r in self.entities(["COUNTRY"]).groupBy(F.lower("entity").alias("n")).agg(F.min("entity").alias("entity")).orderBy("n").collect()]
            answer = "Countries mentioned: " + (", ".join(names) or "none")
        elif kind == "GLOSSARY":
            answer = "Glossary: " + (", ".join(r.term for r in self.glossary().collect()) or "(no terms)")
        elif kind == "SUMMARY":
            rows = self.summarize(prompt, 4, k).collect()
            citations = [{"doc_id": r.doc_id, "snippet": r.sentence} for r in rows]
            answer = "\n".join(["Summary:", *(f"- {r.sentence} [{r.doc_id}]" for r in rows)]) if rows else "No summary evidence found."
        else:
            rows = self.search(prompt, k).collect()
            citations = [{"doc_id": r.doc_id, "start": r.start, "end": r.end, "snippet": " ".join(r.text.split())[:220]} for r in rows]
            answer = "\n".join(f"{i}) {c['snippet'][:180]} [{c['doc_id']}:{c['start']}-{c['end']}]" for i, c in enumerate(citations, 1)) or "No results found."
        if redact:
            answer = self._redact(answer)
            for c in citations:
                c["snippet"] = self._redact(c["snippet"])
        return {"answer": answer, "citations": citations, "intent": kind}

    def generate(self, prompt: str, structured: bool = False, **options) -> str:
        """The answer to a prompt, or all of ``query`` as JSON."""
        result = self.query(prompt, **options)
        return json.dumps(result, ensure_ascii=False, default=str) if structured else result["answer"]

    def stream(self, prompt: str, **options):
        yield from R.stream(self.generate(prompt, **options), 80)

    def _redact(self, s: str) -> str:
        return self.spark.range(1).select(T.redact_pii(F.lit(s)).alias("s")).first().s

    def query_multi(self, prompt: str, k: int = 4) -> dict:
        """Each question of a prompt in turn; 'there' and 'it' stand for the last place and subject, answers need evidence."""
        state: dict[str, str] = {}
        parts = []
        for q in split_questions(prompt):
            resolved = resolve_references(q, state)
            if re.search(r"\b(summar|policy|polic)", resolved, re.I):
                rows = self.summarize(resolved, 3, 5).collect()
                answer = " ".join(r.sentence for r in rows)
                cites = [(r.doc_id, None, None) for r in rows]
            else:
                rows = [r for r in self.search(resolved, k).collect() if r.score > 0 and evidence(resolved, r.text)]
                answer = " ".join(rows[0].text.split())[:180] if rows else ""
                cites = [(r.doc_id, r.start, r.end) for r in rows]
            parts.append({"question": q, "resolved": resolved, "answer": self._redact(answer) if answer else "Not found in local corpus.", "citations": list(dict.fromkeys(cites))})
            remember(resolved, state)
        if not parts:
            return {"answer": "No query provided.", "parts": [], "citations": []}
        answer = "\n".join(f"{i}) {p['answer']}" for i, p in enumerate(parts, 1))
        return {"answer": answer, "parts": parts, "citations": list(dict.fromkeys(c for p in parts for c in p["citations"])), "state": state}

    def save(self, path: str) -> None:
        self.sources.write.mode("overwrite").parquet(f"{path}/sources")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.entities().write.mode("overwrite").parquet(f"{path}/entities")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw):
        e = cls(spark, **kw)
        e.sources, e._chunks, e._entities = (spark.read.parquet(f"{path}/{x}") for x in ("sources", "chunks", "entities"))
        return e


def resolve_references(question: str, state: dict[str, str]) -> str:
    """'there' becomes 'in PLACE' and 'it' the subject, where they are known."""
    out = question
    if "place" in state:
        out = re.sub(r"\b(?:in |at )?there\b", f"in {state['place']}", out, flags=re.I)
    if "subject" in state:
        out = re.sub(r"\bit\b", state["subject"], out, flags=re.I)
    return out


def remember(question: str, state: dict[str, str]) -> None:
    if m := re.search(r"(?:where is|\bin)\s+([A-Z][\w-]+(?:\s+[A-Z][\w-]+)*)", question):
        state["place"] = m[1]
    if m := re.search(r"price\s+of\s+([\w -]+?)(?:\s+in\b|$)", question, re.I):
        state["subject"] = m[1].strip()


def evidence(question: str, text: str) -> bool:
    """Questions for prices need an amount in the text, those for hours a time."""
    if re.search(r"\b(price|cost|amount)\b", question, re.I) and not re.search(r"[$€£]\s?\d|\b\d+(?:[,.]\d+)?\s?(?:usd|eur|zmw|kwacha|dollars?)\b|\b(?:price|cost)\w*\b.{0,40}\d", text, re.I | re.S):
        return False
    return not (re.search(r"\b(hours|opening|open|business start)\b", question, re.I) and not re.search(r"\b\d{1,2}(?::\d\d)?\s?(?:am|pm|h)\b|\b\d{1,2}:\d\d\b", text, re.I))
