import regex
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.fluent import Text
from loomspark.operators import nlp as N
from loomspark.operators.sentiment import SentimentAnalyzer


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_text_functions(spark):
    t = F.col("text")
    fluent = T.collapse(T.remove_punctuation(T.remove_emoji(F.lower(T.strip_accents(t)))))
    assert one(spark, "  Héllo,   WORLD! 😀  ", fluent) == "hello world"
    assert one(spark, "a😀b☀", T.keep_emoji(t)) == "😀☀" and one(spark, "a, b!", T.keep_punctuation(t)) == ",!"
    assert one(spark, "Crème Brûlée & Co!", T.slug(t)) == "creme-brulee-co"
    assert one(spark, "The quick brown fox jumps over the lazy dog.", T.initials(t)) == "TQBFJO"
    assert one(spark, "a b c", T.ngrams(t)) == ["a b", "b c"] and one(spark, "a", T.ngrams(t)) == ["a"]
    assert one(spark, "Dr. Smith arrived. He left at 5 p.m. sharp.", T.sentences(t)) == ["Dr. Smith arrived.", "He left at 5 p.m.", "sharp."]
    assert one(spark, "", T.sentences(t)) == [] and one(spark, None, T.sentences(t)) is None
    assert one(spark, "é", T.normalize_unicode(t)) == "é" and one(spark, None, T.slug(t)) is None


def test_pii_and_terms(spark):
    t = F.col("text")
    assert one(spark, "Email me at a@b.com or visit https://example.com", T.redact_pii(t)) == "Email me at [EMAIL] or visit [URL]"
    assert one(spark, "call +1 555-010-9999 now", T.redact_pii(t)) == "call +[PHONE] now"
    assert one(spark, "card 4539578763621486", T.redact_pii(t)) == "card [PHONE]"  # phones come first
    assert one(spark, "This is secrat and INTERNAL note", T.find_terms(t, ["secret", "internal"], fuzzy=True)) == ["secret", "internal"]
    assert one(spark, "This is secrat and INTERNAL note", T.find_terms(t, ["secret", "internal"])) == ["internal"]
    assert one(spark, "An internal note", T.redact_terms(t, ["internal"])) == "An [SENSITIVE] note"


def test_fuzzy_terms_match_brute_force(spark):
    terms, texts = ["secret", "note", "ab"], ["secrets here", "the nqte", "abc", "b", "", "Sécret nota", "no"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.find_terms("text", terms, True).alias("x")).orderBy("i").collect()
    for (_, x), t in zip(got, texts):
        assert x == [w for w in terms if w in t.lower() or any(y and lev(w, y) <= 1 for y in regex.split(r"[^\p{L}\p{N}_]+", t.lower()))]


def test_similarities(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"], "kitten", "sitten")], "a array<string>, b array<string>, s string, t string")
    got = d.select(T.jaccard("a", "b"), T.levenshtein_similarity("s", "t")).first()
    assert abs(got[0] - 1 / 3) < 1e-12 and abs(got[1] - 5 / 6) < 1e-12


def test_language_and_routes(spark):
    assert one(spark, "The quick brown fox jumps over the lazy dog.", N.detect_language("text")).language == "en"
    assert one(spark, "42", N.detect_language("text")).language == "unknown" and one(spark, None, N.detect_language("text")).language is None
    assert one(spark, "BEM ", N.language_route("text")).direction == "bem->en"


def test_pos(spark):
    tags = lambda s, lang="en": [(x.token, x.pos) for x in one(spark, s, N.pos_tags("text", lang))]
    assert tags("Alice is running quickly") == [("Alice", "PROPN"), ("is", "VERB"), ("running", "VERB"), ("quickly", "ADV")]
    assert tags("lentement", "fr") == [("lentement", "ADV")]


def test_rake():
    got = dict(N.rake("deep learning of deep models and learning", frozenset(["of", "and"]), 10))
    assert got["deep learning"] == 2 + 1.5 and got["deep models"] == 4.0


def test_entities(spark):
    text = "Ping 192.168.0.1 at 13:45, progress 98%, id 123e4567-e89b-42d3-a456-426614174000 #ops @dev_team"
    d = spark.createDataFrame([(1, text), (2, "Lusaka is not in the U.S."), (3, None), (4, "")], "i int, text string")
    tagger = N.NerTagger({"united states": "COUNTRY", "u.s.": "COUNTRY", "lusaka": "CITY"})
    rows = tagger.extract(d, "i").collect()
    assert {"IP_ADDRESS", "TIME", "PERCENT", "UUID", "HASHTAG", "MENTION"} <= {x.label for x in rows if x.i == 1}
    assert {(x.entity, x.label) for x in rows if x.i == 2} >= {("Lusaka", "CITY"), ("U.S.", "COUNTRY")} and {x.i for x in rows} == {1, 2}
    assert all(text[x.start : x.end] == x.entity for x in rows if x.i == 1)
    spans = [("United", "PROPER_NOUN", 0, 6, 0.6), ("United States", "COUNTRY", 0, 13, 0.9)]
    assert [s[0] for s in N.resolve_spans(spans, nesting=False)] == ["United States"] and len(N.resolve_spans(spans)) == 2
    both = [("Paris", "CITY", 0, 5, 0.9), ("Lima", "CITY", 10, 14, 0.9)]
    assert N.disambiguate(both, "Paris and Lima +33", {"paris": ["US", "FR"]}, {"33": "FR"})[0][0] == "Paris, FR"


def test_perceptrons(spark, tmp_path):
    data = [[("Alice", "PROPN"), ("runs", "VERB")], [("Bob", "PROPN"), ("sleeps", "VERB")]]
    m = N.PerceptronTagger(5).fit(data)
    assert m.tag(["Alice", "sleeps"]) == ["PROPN", "VERB"]
    d = spark.createDataFrame([(["Bob", "runs"],)], "w array<string>")
    assert d.select(m.tags_of(F.col("w"))).first()[0] == ["PROPN", "VERB"]
    ner = N.PerceptronNer(8).fit([[("Alice", "B-PER"), ("Smith", "I-PER"), ("runs", "O")], [("we", "O"), ("met", "O"), ("Bob", "B-PER")]])
    assert ner.extract(spark.createDataFrame([(1, "Alice Smith runs")], "i int, text string"), "i").first()[1:5] == ("Alice Smith", "PER", 0, 11)


def test_translation_and_lexicons(spark):
    t = N.Translator({"above abdomen": "pa mulu ifumo"}, {"house": "ing'anda"}, (("(\\w+) red", "red \\1"),))
    assert t.translate_one("Above Abdomen!") == "Pa mulu ifumo!" and t.translate_one("House, x red") == "Ing'anda, red x"
    lex = spark.createDataFrame([("happy", "feeling joy"), ("glad", "feeling joy and pleasure"), ("sad", "without it")], "word string, definition string")
    assert [x.word for x in N.words_from_meaning(lex, "joy pleasure").collect()] == ["glad", "happy"]
    words = spark.createDataFrame([("happy", "s1")], "word string, synset string")
    sets = spark.createDataFrame([("s1", "joy", ["glad", "Happy"])], "synset string, definition string, synonyms array<string>")
    assert {x.term for x in N.expand_terms(words, sets, spark.createDataFrame([("Happy",)], "word string")).collect()} == {"happy", "glad"}


def test_chain_and_sentiment(spark):
    assert one(spark, "  Héllo,   WORLD! 😀  ", Text("text").remove_emoji().remove_punctuation().strip_accents().lower().collapse().column) == "hello world"
    assert one(spark, "a b c", Text("text").ngrams(3)) == ["a b c"] and one(spark, "the thing", Text("text").language()) == "en"
    train = spark.createDataFrame([(0, "bad awful day", "negative"), (1, "good happy day", "positive"), (2, "awful", "negative"), (3, "happy", "positive")], "row_id int, text string, label string")
    m = SentimentAnalyzer(2.0).fit(train)
    got = m.predict(spark.createDataFrame([("so happy",), ("awful bad",), (None,)], "text string")).collect()
    assert [x.prediction for x in got[:2]] == ["positive", "negative"] and 0 <= got[2].score <= 1
