"""Queries: text functions, tokens, keywords, tags, entities over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fluent as C
from ..functions import text as T
from ..operators import explorer as X
from ..operators import nlp as N
from ..sources import readers as S
from .tabular import r6, read

TERMS = ["secret", "internal", "password", "account", "idiot"]


def _docs(spark, sf):
    return read(spark, sf, "documents")


def words_ngrams(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.words("text").alias("w"))
    grams = T.ngrams_of(F.col("w"), 2)
    return d.select("doc_id", F.size("w").alias("n_words"), F.size(grams).alias("n_grams"), F.size(F.array_distinct(grams)).alias("n_distinct"), F.md5(F.array_join(grams, "|")).alias("digest"))


def sentence_split(spark, sf):
    s = _docs(spark, sf).select("doc_id", F.posexplode(T.sentences("text")).alias("nth", "sentence"))
    return s.select("doc_id", "nth", "sentence")


def text_clean(spark, sf):
    t = F.col("text")
    made = {"collapsed": T.collapse(t), "unmarked": T.remove_punctuation(t), "marks": T.keep_punctuation(t), "no_emoji": T.remove_emoji(t), "emoji": T.keep_emoji(t), "low": F.lower(t)}
    return _docs(spark, sf).select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()])


def text_slug(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.slug("text")).alias("slug"), F.md5(T.strip_accents("text")).alias("plain"), F.md5(T.normalize_unicode("text", "NFC")).alias("nfc"))


def text_initials(spark, sf):
    return _docs(spark, sf).select("doc_id", T.initials("text").alias("initials"))


def token_kinds(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.size(T.words(t)).alias("words"), F.size(T.pieces(t)).alias("pieces"), F.size(T.regex_tokens(t)).alias("tokens"))


def lang_detect(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", N.detect_language("text").alias("d"))
    return d.select("doc_id", "lang", F.col("d.language").alias("detected"), F.round("d.score", 12).alias("score"))


def lang_routes(spark, sf):
    return _docs(spark, sf).select("doc_id", N.language_route("lang").alias("r")).select("doc_id", "r.*")


def rake_keywords(spark, sf):
    return N.rake_keywords(_docs(spark, sf), "doc_id").select("doc_id", "rank", "keyword", r6("score").alias("score"))


def pii_redact(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", T.redact_pii("text").alias("redacted"))
    return d.select("doc_id", F.md5("redacted").alias("digest"), (F.col("redacted") != F.col("text")).alias("changed"))


def term_filter(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(T.find_terms("text", TERMS), ",").alias("found"), F.md5(T.redact_terms("text", TERMS)).alias("digest"))


def term_filter_fuzzy(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(T.find_terms("text", TERMS, fuzzy=True), ",").alias("found"))


def pos_tag_counts(spark, sf):
    d = _docs(spark, sf).where(F.col("lang").isin("en", "fr", "es", "de")).select("lang", F.explode(T.words("text")).alias("w"))
    pos = F.lit(None).cast("string")
    for lang in ("en", "fr", "es", "de"):
        pos = F.when(F.col("lang") == lang, N.pos_tag(F.col("w"), lang)).otherwise(pos)
    return d.groupBy("lang", pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def ner_pattern_counts(spark, sf):
    return read(spark, sf, "pages").select("page_id", *[N.count_pattern("html", x).alias(x.lower()) for x in N.ENTITY_PATTERNS])


def word_offsets(spark, sf):
    """Where the words of each document stand."""
    w = _docs(spark, sf).select("doc_id", F.explode(N.word_offsets("text")).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w.start").cast("long")).alias("starts"), F.sum(F.col("w.end").cast("long")).alias("ends"))


def rake_column(spark, sf):
    """Keywords as a column: the best one of each document."""
    k = _docs(spark, sf).select("doc_id", F.get(N.keywords("text", 1), 0).alias("k")).where("k is not null")
    return k.select("doc_id", "k.keyword", r6("k.score").alias("score"))


def definitions_last(spark, sf):
    """Parts' names as words, their types as definitions, of which the last in the order of the file counts."""
    p = read(spark, sf, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("definition"))
    return S.definitions(p)


def title_case(spark, sf):
    """Part names in upper and title case, through the chain of text functions."""
    t = C.Text("p_name")
    return read(spark, sf, "part").select("p_partkey", t.upper().column.alias("upper"), t.lower().title().column.alias("title"))


def ner_entities(spark, sf):
    names = {"United States": "COUNTRY", "U.S.": "COUNTRY", "France": "COUNTRY", "Lusaka": "CITY", "Paris": "CITY"}
    return N.NerTagger(names).extract(_docs(spark, sf), "doc_id").select("doc_id", "entity", "label", "start", "end", "confidence")


def glossary(spark, sf):
    return X.glossary_terms(_docs(spark, sf), 12)


def name_similarity(spark, sf):
    """All pairs of distinct part names, compared as word sets and as strings."""
    n = read(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = n.join(n.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", r6(T.jaccard(F.split("a", " "), F.split("b", " "))).alias("jaccard"), r6(T.levenshtein_similarity("a", "b")).alias("lev"))


def meaning_lookup(spark, sf):
    """Benchmark items as a dictionary: those whose text has most of the query's words."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("word"), F.col("text").alias("definition"))
    return N.words_from_meaning(b, "the er on", 10)


def translate_words(spark, sf):
    """A word table on the texts of conversations."""
    table = N.Translator({}, {"the": "le", "and": "et", "of": "de"})
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(table.translate(F.col("text"))).alias("digest"))


QUERIES = {f.__name__: f for f in (words_ngrams, sentence_split, text_clean, text_slug, text_initials, token_kinds, lang_detect, lang_routes, rake_keywords, pii_redact, term_filter, term_filter_fuzzy, pos_tag_counts, ner_pattern_counts, word_offsets, rake_column, definitions_last, title_case, ner_entities, glossary, name_similarity, meaning_lookup, translate_words)}


def q(s: str) -> str:
    """An SQL string."""
    return "'" + s.replace("'", "''") + "'"


WORDS = q(T.LETTER_START)
_ENDS = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
_STOP = ", ".join(q(w) for w in T.STOPWORDS)
_PROFILE = ", ".join(f"({i}, '{lang}', '{g}', {w})" for i, (lang, p) in enumerate(N.PROFILES.items()) for g, w in p.items() if len(g) == 3)
_FIND = " || ',' || ".join(f"case when contains(lower(text), '{t}') then '{t}' end" for t in TERMS)
_found = "array_to_string([x for x in [" + ", ".join(f"case when contains(lower(text), '{t}') then '{t}' end" for t in TERMS) + "] if x is not null], ',')"


def _redact() -> str:
    out = "text"
    for t in TERMS:
        out = rf"regexp_replace({out}, '(?i)\b{t}\b', '[SENSITIVE]', 'g')"
    return out


def _pos() -> str:
    parts = []
    for lang in ("en", "fr", "es", "de"):
        cases = " ".join(f"when lower(w) = '{w}' then '{t}'" for w, t in N.pos_lexicon(lang).items())
        cases += r" when regexp_matches(lower(w), '^\d+(?:[.,]\d+)?$') then 'NUM' when regexp_matches(w, '^[[:punct:]]+$') then 'PUNCT' "
        cases += " ".join(f"when regexp_matches(lower(w), '{p}') then '{t}'" for t, p in N._SUFFIX.get(lang, ()))
        cases += r" when regexp_matches(w, '^[A-Z][\p{L}-]+$') then 'PROPN' else 'NOUN'"
        parts.append(f"select lang, case {cases} end as pos, count(*) as n from (select lang, unnest(regexp_extract_all(text, {WORDS})) w from documents where lang = '{lang}') group by all")
    return " union all ".join(parts)


def _ner() -> str:
    # no lookbehind in this engine: what must not stand before a match is part of it
    pattern = lambda x: q(N.ENTITY_PATTERNS[x].replace(r"(?<!\w)", r"(?:^|[^\w])"))
    return "select page_id, " + ", ".join(f"cast(len(regexp_extract_all(html, {pattern(x)})) as int) as {x.lower()}" for x in N.ENTITY_PATTERNS) + " from pages"


# words and all else, one by one, in the order of the text
_PIECES = f"regexp_extract_all(text, {q('(?s)' + T.LETTER_START + '|.')})"
_WORDLIKE = r"'^\p{L}'"


ORACLE_SQL = {
    "words_ngrams": f"""with w as (select doc_id, regexp_extract_all(text, {WORDS}) w from documents),
        g as (select doc_id, len(w) n, case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end g from w)
        select doc_id, cast(n as int) as n_words, cast(len(g) as int) as n_grams, cast(len(list_distinct(g)) as int) as n_distinct, md5(array_to_string(g, '|')) as digest from g""",
    "sentence_split": rf"""with p as (select doc_id, string_split(regexp_replace(regexp_replace(trim(text), '(?i)({_ENDS})\s+', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) p from documents),
        s as (select doc_id, [x for x in [trim(replace(y, chr(1), ' ')) for y in p] if x <> ''] s from p)
        select doc_id, cast(generate_subscripts(s, 1) - 1 as int) as nth, unnest(s) as sentence from s""",
    "text_clean": rf"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as collapsed, md5(regexp_replace(text, '[\p{{P}}\p{{S}}]+', ' ', 'g')) as unmarked, md5(array_to_string(regexp_extract_all(text, '[\p{{P}}\p{{S}}]+'), '')) as marks,
        md5(regexp_replace(text, '{T.EMOJI}', '', 'g')) as no_emoji, md5(array_to_string(regexp_extract_all(text, '{T.EMOJI}'), '')) as emoji, md5(lower(text)) as low from documents""",
    "text_slug": "select doc_id, md5(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug, md5(strip_accents(text)) as plain, md5(nfc_normalize(text)) as nfc from documents",
    "text_initials": f"select doc_id, replace(upper(array_to_string([w[1] for w in regexp_extract_all(text, {WORDS})[1:6]], '')), 'ẞ', 'SS') as initials from documents",
    "token_kinds": rf"select doc_id, cast(len(regexp_extract_all(text, {WORDS})) as int) as words, cast(len(regexp_extract_all(text, '\S+')) as int) as pieces, cast(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_\-]+')) as int) as tokens from documents",
    "lang_detect": rf"""with s as (select doc_id, lang, ' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\p{{L}}\s]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ' s from documents),
        t as (select doc_id, lang, substr(s, i, 3) g, i from (select doc_id, lang, s, unnest(range(1, len(s) - 1)) i from s where length(s) > 2)),
        c as (select doc_id, lang, g, count(*) c, sum(count(*)) over (partition by doc_id) tot, row_number() over (partition by doc_id order by count(*) desc, min(i)) rn from t group by doc_id, lang, g),
        p(o, l, g, w) as (values {_PROFILE}), langs as (select distinct o, l from p),
        z as (select doc_id, c.lang, o, l, sum(coalesce(cast(p.w * 1000 as bigint), 0) * c) / (1000.0::double * any_value(tot)) score from (select * from c where rn <= 250) c cross join langs left join p using (o, l, g) group by doc_id, c.lang, o, l),
        b as (select *, row_number() over (partition by doc_id order by score desc, o) rn from z)
        select d.doc_id, d.lang, coalesce(l, 'unknown') as detected, round(coalesce(score, 0), 12) as score from documents d left join (select * from b where rn = 1) b using (doc_id)""",
    "lang_routes": """select doc_id, 'unicode_word' as tokenizer, case lang when 'bem' then 'zambia-bemba' when 'nya' then 'zambia-nyanja' when 'toi' then 'zambia-tonga' when 'loz' then 'zambia-lozi' else 'default' end as ner_preset,
        case when lang in ('bem', 'nya', 'toi', 'loz') then lang || '->en' else 'en->bem' end as direction from documents""",
    "rake_keywords": f"""with w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from (select doc_id, regexp_extract_all(lower(text), {WORDS}) ws from documents)),
        g as (select doc_id, w, i, w in ({_STOP}) st, count(*) filter (w in ({_STOP})) over (partition by doc_id order by i) grp from w),
        p as (select doc_id, grp, w, i, count(*) over (partition by doc_id, grp) len from g where not st),
        s as (select doc_id, w, (sum(len - 1) + count(*)) / count(*)::double sc from p group by doc_id, w),
        f as (select doc_id, grp, string_agg(w, ' ' order by i) as keyword, sum(sc) score, min(i) i from p join s using (doc_id, w) group by doc_id, grp),
        k as (select doc_id, keyword, round(max(score), 6) as score, min(i) i from f group by doc_id, keyword)
        select doc_id, cast(row_number() over (partition by doc_id order by score desc, i) as int) as rank, keyword, score from k qualify row_number() over (partition by doc_id order by score desc, i) <= 10""",
    "pii_redact": f"""with r as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, {q(T.EMAIL)}, '[EMAIL]', 'g'), {q(T.PHONE)}, '[PHONE]', 'g'), {q(T.URL)}, '[URL]', 'g') r from documents)
        select doc_id, md5(r) as digest, r <> text as changed from r""",
    "term_filter": f"select doc_id, {_found} as found, md5({_redact()}) as digest from documents",
    "pos_tag_counts": _pos(),
    "ner_pattern_counts": _ner(),
    "word_offsets": f"""with p as (select doc_id, unnest(ps) p, generate_subscripts(ps, 1) i from (select doc_id, {_PIECES} ps from documents)), o as (select doc_id, p, coalesce(sum(length(p)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) st from p)
        select doc_id, count(*) as n, cast(sum(st) as bigint) as starts, cast(sum(st + length(p)) as bigint) as ends from o where regexp_matches(p, {_WORDLIKE}) group by doc_id""",
    "rake_column": "with r as (RAKE) select doc_id, keyword, score from r where rank = 1",
    "definitions_last": "select lower(trim(p_name)) as word, arg_max(trim(p_type), i) as definition from (select *, row_number() over () i from part) where trim(p_name) <> '' group by 1",
    "title_case": "select p_partkey, upper(p_name) as upper, array_to_string([upper(w[1]) || w[2:] for w in string_split(lower(p_name), ' ')], ' ') as title from part",
    "term_filter_fuzzy": f"""select doc_id, array_to_string([x for x in [{', '.join(f"case when contains(low, '{t}') or len([w for w in ws if w <> '' and abs(length(w) - {len(t)}) <= 1 and levenshtein(w, '{t}') <= 1]) > 0 then '{t}' end" for t in TERMS)}] if x is not null], ',') as found
        from (select doc_id, lower(text) low, list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) ws from documents)""",
    "translate_words": f"""select conv_id, turn, md5(array_to_string([case lower(p) when 'the' then case p when 'THE' then 'LE' when 'the' then 'le' else case when upper(p[1]) = p[1] then 'Le' else 'le' end end when 'and' then case p when 'AND' then 'ET' else case when upper(p[1]) = p[1] then 'Et' else 'et' end end when 'of' then case p when 'OF' then 'DE' else case when upper(p[1]) = p[1] then 'De' else 'de' end end else p end for p in ps], '')) as digest from (select conv_id, turn, {_PIECES} ps from conversations)""",
    "glossary": f"select w as term, count(*) as n from (select unnest(regexp_extract_all(lower(text), {WORDS})) w from documents) where length(w) >= 4 group by w order by n desc, w limit 12",
    "name_similarity": """with n as (select distinct p_name a from part), p as (select x.a, y.a b, string_split(x.a, ' ') u, string_split(y.a, ' ') v from n x join n y on x.a < y.a)
        select a, b, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v)))::double, 6) as jaccard, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::double, 6) as lev from p""",
    "meaning_lookup": """with s as (select item_id as word, contains(lower(text), 'the')::int + contains(lower(text), 'er')::int + contains(lower(text), 'on')::int as score from benchmark)
        select word, score from s where score > 0 order by score desc, word limit 10""",
}
ORACLE_SQL["rake_column"] = ORACLE_SQL["rake_column"].replace("RAKE", ORACLE_SQL["rake_keywords"])
