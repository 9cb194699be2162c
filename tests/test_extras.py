"""Remote models over a stand-in transport, contracts, datasets, places in texts, facades, and the guard of SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.fluent import Text
from loomspark.operators import agents as A
from loomspark.operators import contracts as C
from loomspark.operators import explorer as X
from loomspark.operators import features, models, nlp, retrieval
from loomspark.operators import geo as G
from loomspark.operators import providers as P
from loomspark.operators.base import InvalidArgument
from loomspark.operators.ordering import ranked
from loomspark.sources import datasets as D
from loomspark.sources import readers as S
from loomspark.sources import stores as K


class Wire:
    """Answers in turn and keeps what was sent."""

    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def __call__(self, url, headers, body):
        self.sent.append((url, headers, body))
        return self.answers.pop(0)


def test_embedders():
    w = Wire({"data": [{"embedding": [0.1, 0.2]}, {"embedding": [0.3, 0.4]}]})
    e = P.RemoteEmbedder(P.OpenAI("k", base="https://x/v1/"), w)
    assert e.embed(["a", "b"]) == [[0.1, 0.2], [0.3, 0.4]] and isinstance(e, C.EmbeddingProvider)
    assert w.sent == [("https://x/v1/embeddings", {"Authorization": "Bearer k"}, {"model": "text-embedding-3-small", "input": ["a", "b"]})]
    w = Wire({"data": [{"embedding": [0.9, 0.8]}]})
    assert P.RemoteEmbedder(P.Azure("k", "https://y/", "my dep"), w).embed_query("a") == [0.9, 0.8]
    assert w.sent[0][0] == "https://y/openai/deployments/my%20dep/embeddings?api-version=2024-02-15-preview" and w.sent[0][1] == {"api-key": "k"}
    w = Wire({"embedding": [0.7]}, {"embedding": [0.6]})
    assert P.RemoteEmbedder(P.Ollama(), w).embed(["a", "b"]) == [[0.7], [0.6]] and w.sent[1][2] == {"model": "nomic-embed-text", "prompt": "b"}
    for bad in ({}, {"data": [{"x": 1}]}):
        with pytest.raises(InvalidArgument):
            P.RemoteEmbedder(P.OpenAI("k"), Wire(bad)).embed(["a"])
    with pytest.raises(InvalidArgument):
        P.OpenAI("")
    with pytest.raises(InvalidArgument):
        P.Azure("k", "", "d")


def test_models_and_the_factory():
    w = Wire({"choices": [{"message": {"content": "hi"}}]})
    assert P.RemoteModel(P.OpenAI("k"), w).generate("q") == "hi"
    assert w.sent[0][2] == {"model": "gpt-4o-mini", "messages": [{"role": "user", "content": "q"}], "temperature": 0.2, "max_tokens": 700}
    assert P.RemoteModel(P.Azure("k", "https://y", "d"), Wire({})).generate("q") == ""
    with pytest.raises(InvalidArgument, match="429"):
        P.RemoteModel(P.Azure("k", "https://y", "d"), Wire({"error": {"code": "429", "message": "slow"}})).generate("q")
    w = Wire({"message": {"content": "yo"}})
    assert P.RemoteModel(P.Ollama(), w).generate("q") == "yo" and w.sent[0][2]["stream"] is False
    assert isinstance(P.model_from({}), P.EchoModel) and "".join(P.model_from({}).stream("x" * 300)) == retrieval.echo("x" * 300)
    m = P.model_from({"RAG_LLM_PROVIDER": " Azure ", "AZURE_OPENAI_API_KEY": "k", "AZURE_OPENAI_ENDPOINT": "e", "AZURE_OPENAI_CHAT_DEPLOYMENT": "d"})
    assert m.provider == P.Azure("k", "e", "d") and P.model_from({"OPENAI_API_KEY": "k"}, "openai").provider.key == "k" and P.model_from({}, "ollama").provider == P.Ollama()
    assert isinstance(P.EchoModel(), C.StreamingLanguageModel) and isinstance(m, C.LanguageModel) and not isinstance(m, C.StreamingLanguageModel)


def test_routing_models():
    tools = A.standard_tools()
    w = Wire({"choices": [{"message": {"content": '```json\n{"type":"tool_call","tool":"math","input":{"expression":"10+5"}}\n```'}}]}, {"choices": [{"message": {"content": '{"type":"final","content":"done"}'}}]})
    agent = A.RoutingAgent(tools, P.RemoteRouter(P.Azure("k", "https://y", "gpt-mini"), w))
    out = agent.chat("what is 10+5?")
    assert out["answer"] == "done" and [c["result"] for c in out["tool_calls"]] == ["15"]
    assert w.sent[0][2]["temperature"] == 1 and w.sent[1][2]["messages"][-1] == {"role": "assistant", "content": "TOOL_RESULT: 15"} and "- math:" in w.sent[0][2]["messages"][0]["content"]
    assert P.OpenAI("k").routing_options() == {"temperature": 0.1} and P.Azure("k", "e", "big").routing_options() == {"temperature": 0.1} and P.Ollama().routing_options() == {}
    assert isinstance(P.RemoteRouter(P.Ollama()), C.RoutingModel) and isinstance(tools["math"], C.ToolContract)


def test_contracts_hold_for_what_is_here(spark):
    assert isinstance(models.KNearestNeighbors(), C.Predictor) and isinstance(models.LogisticRegression(), C.OnlineLearner)
    assert isinstance(features.StandardScaler(), C.Transformer) and isinstance(models.RandomForestClassifier(), (C.RandomStateAware, C.Persistable)) and isinstance(models.MLPBinaryClassifier(), C.Parametric)
    assert isinstance(nlp.PerceptronTagger(), C.TrainablePosTagger) and isinstance(nlp.NerTagger(), C.EntityTagger) and isinstance(nlp.PerceptronNer(), C.TrainableEntityTagger)
    assert isinstance(nlp.Translator({}, {}), C.TextTranslator) and isinstance(K.MemoryVectorStore(spark), C.PersistableVectorStore) and isinstance(retrieval.TfidfVectorizer(), C.Vectorizer)


REFUSED = [
    "with a as (select pw from g_secret), g_secret as (select 1 as one) select pw from a",
    "select reflect('java.lang.System','getProperty','user.home')",
    "select java_method('java.lang.System','getProperty','user.home') from g_open",
    "select try_reflect('java.lang.System','getProperty','user.home') from g_open",
    "select transform(id) using 'cat' from g_open",
    "select * from range(3)",
    "select * from parquet.`/tmp/x.parquet`",
    "select * from identifier('g_secret')",
    "select id from g_open where exists (select 1 from g_secret)",
    "select (select max(pw) from g_secret) x from g_open",
    "select id from g_open union all select 1 from (with t as (select * from g_secret) select * from t)",
    "select not_a_builtin(id) from g_open",
]


def test_guarded_sql_refuses(spark):
    spark.createDataFrame([(1, "a")], "id int, note string").createOrReplaceTempView("g_open")
    spark.createDataFrame([("x",)], "pw string").createOrReplaceTempView("g_secret")
    g = A.GuardedSql(spark, ["g_open"])
    for sql in REFUSED:
        with pytest.raises(InvalidArgument):
            g.frame(sql)
    free = A.GuardedSql(spark, None, {"g_open": ["id"]})
    for sql in ("select note from default.g_open", "select note from g_open", "select * from csv.`/etc/passwd`"):
        with pytest.raises(InvalidArgument):
            free.frame(sql)
    for sql, n in (("with g_secret as (select id from g_open) select id from g_secret", 1), ("with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select n from r", 3), ("select upper(note), sum(id) over () from g_open", 1)):
        assert len(g.frame(sql).collect()) == n
    assert A.GuardedSql(spark, ["g_open"], functions=("not_a_builtin",)).check_names(REFUSED[-1]) == ["g_open"]


@pytest.fixture
def places(spark):
    countries = spark.createDataFrame([("Zambia", "ZM", "ZMB", "260"), ("Kenya", "KE", "KEN", "254"), ("United States", "US", "USA", "1")], "name string, iso2 string, iso3 string, phone_code string")
    states = spark.createDataFrame([("Nairobi Area", "30", "KE")], "name string, state_code string, iso2 string")
    middle = spark.createDataFrame([("ZM", "Zambia", -15.0, 28.0)], "cca2 string, name string, lat double, lon double")
    cities = spark.createDataFrame([(1, "Lusaka", "ZM", "", -15.4167, 28.2833), (2, "Nairobi", "KE", "30", -1.286389, 36.817223), (3, "Paris", "FR", "", 48.85, 2.35), (4, "Paris", "US", "", 33.66, -95.55)], "city_id long, name string, country_code string, state_code string, lat double, lon double")
    return G.Geo(countries, states, middle, cities)


def test_places_in_texts(spark, places):
    docs = spark.createDataFrame([(1, "Lusáka is not in Kenya."), (2, None)], "doc_id long, text string")
    got = {(r.entity, r.label, r.start, r.confidence) for r in nlp.GeoEntityRecognizer(places).extract(docs, "doc_id").collect()}
    assert got == {("Lusáka", "CITY", 0, 1.0), ("Kenya", "COUNTRY", 17, 1.0)}
    tagger = nlp.NerTagger().with_geo_gazetteer(places)
    assert tagger.cities == {"paris": ["FR", "US"]} and tagger.phone["260"] == "ZM"
    nlp.know(places)
    try:
        labels = lambda t: {(r.entity, r.label) for r in t.extract(docs, "doc_id").collect()}
        assert ("Kenya", "COUNTRY") in labels(nlp.NerTagger()) and ("Kenya", "COUNTRY") not in labels(nlp.NerTagger().without_auto_knowledge())
        assert nlp.NerTagger().with_auto_knowledge_limit(5).auto_limit == 1000
    finally:
        nlp.know(None)
    assert ("Kenya", "PROPER_NOUN") in labels(nlp.NerTagger())
    aliased = nlp.NerTagger().with_aliases({"Zambia": ["Chipolopolo land"]}, "COUNTRY").tagger()("Chipolopolo land won")
    assert (aliased[0][0], aliased[0][1]) == ("Chipolopolo land", "COUNTRY")


def test_nearest_matches_brute_force(spark, places, monkeypatch):
    r = np.random.default_rng(5)
    cities = spark.createDataFrame([(i, f"c{i}", "AA" if i % 3 else "BB", "", float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-80, 80, 300), r.uniform(-180, 180, 300)))] + [(900, "x", "AA", "", 10.0, 10.0), (901, "x", "AA", "", 10.0, 10.0)], "city_id long, name string, country_code string, state_code string, lat double, lon double")
    geo = G.Geo(places.countries, places.states, places.places, cities)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-90, 90, 40), r.uniform(-180, 180, 40)))] + [(100, 10.0, 10.0)], "p long, lat double, lon double")
    ask = lambda: [sorted((x.p, x.rank, x.city_id, round(x.distance_km, 6)) for x in geo.nearest_cities(points, "p", 3, **kw).collect()) for kw in ({}, {"country": "BB"}, {"within_km": 2000.0})]
    fast = ask()
    monkeypatch.setattr(G, "MANY", 0)
    assert fast == ask() and len(fast[0]) == 41 * 3


def test_facades(spark, places):
    d = spark.createDataFrame([("happy",), ("Sad",)], "w string")
    e = nlp.SemanticExplorer(
        spark.createDataFrame([("happy", "feeling glad"), ("sad", "not glad at all"), ("glad", "feeling happy")], "word string, definition string"),
        spark.createDataFrame([("happy", "s1"), ("odd", "s2")], "word string, synset string"),
        spark.createDataFrame([("s1", "joyful", ["glad", "cheerful"]), ("s2", "strange", ["weird"])], "synset string, definition string, synonyms array<string>"),
    )
    got = {r.word: (r.definition, r.synonyms) for r in Text("w").semantics(d, e).collect()}
    assert got == {"happy": ("feeling glad", ["cheerful", "glad"]), "sad": ("not glad at all", [])}
    assert e.word_insights(" Odd ")["definition"] == "strange" and e.word_insights("happy", 1)["synonyms"] == ["cheerful"]
    assert e.words_by_meaning("feeling glad")[:1] == ["happy"] and e.semantic_search("feeling", 2, 1) == {"matches": ["glad", "happy"], "expanded": ["glad", "happy", "cheerful"]}
    t = spark.createDataFrame([("Ping Alice Smith at 13:45 and the data of the mine is for the tools",)], "t string")
    row = t.select(Text("t").keywords(2).alias("k"), Text("t").entities().alias("e"), Text("t").language_with_score().alias("l"), nlp.word_offsets("t").alias("o")).first()
    assert len(row.k) == 2 and {x.label for x in row.e} >= {"TIME", "PROPER_NOUN"} and row.l.language == "en" and (row.o[1].token, row.o[1].start, row.o[1].end) == ("Alice", 5, 10)


def test_bemba():
    m = nlp.EnglishBemba.of({"above abdomen": ["pa mulu ifumo"], "water": ["amenshi", "x"], "none": [" "]})
    assert m.translate_one("Above Abdomen! Water") == "Pa mulu ifumo! Amenshi" and m.translate_word("WATER") == "AMENSHI"
    assert m.with_model(lambda p: "\n better \nmore").translate_one("water") == "better" and m.with_model(lambda p: 1 / 0).translate_one("water") == "amenshi"
    assert m.with_model(lambda p: " ").translate_one("water") == "amenshi"


def test_explorer_extras(spark, tmp_path):
    e = X.Explorer(spark).add_text("d1", "Refund policy for Alice at 13:45.").add_text("d2", "Café 13:46 and 13:47.")
    assert [(r.doc_id, r.nth, r.start, r.end, r.match) for r in e.regex(r"\d\d:\d\d").collect()] == [("d1", 0, 27, 32, "13:45"), ("d2", 0, 5, 10, "13:46"), ("d2", 1, 15, 20, "13:47")]
    answer = e.generate("refund policy")
    assert answer.startswith("1) Refund policy") and "".join(e.stream("refund policy")) == answer and json.loads(e.generate("refund policy", structured=True))["intent"] == "SEARCH"
    rows = [{"doc_id": "d1", "start": 0, "end": 5}]
    assert X.format_table(rows) == "doc_id | start | end\n--- | --- | ---\nd1 | 0 | 5" and X.format_table([]) == "(empty)" and X.format_citations(rows) == "d1:0-5" and X.format_citations([]) == "No citations."
    e.save(str(tmp_path / "i"))
    again = X.Explorer.load(spark, str(tmp_path / "i"))
    key = lambda x: sorted((r.doc_id, r.entity, r.label, r.start) for r in x.entities().collect())
    assert key(again) == key(e)
    assert "Bob" in {r.entity for r in again.add_text("d3", "Bob came").entities().collect()}


def test_datasets(spark, tmp_path, places):
    (tmp_path / "dictionary/en").mkdir(parents=True)
    (tmp_path / "dictionary/en/en.csv").write_text("word,definition\nhappy,glad\nHappy ,very glad\nsad,\n")
    reg = D.DatasetRegistry(spark, str(tmp_path))
    report = {r.name: (r.exists, r["size"], len(r.sha1)) for r in reg.integrity_report().collect()}
    assert report["dictionary-en"] == (True, 49, 40) and report["wordnet"] == (False, 0, 0) and len(report) == reg.list_datasets().count() == 7 and reg.licenses().count() == 5
    d = S.definitions(S.csv_table(spark, str(tmp_path / "dictionary/en/en.csv")))
    assert [(r.word, r.definition) for r in d.collect()] == [("happy", "very glad")]
    cache = D.DatasetCache(spark, str(tmp_path / "cache"))
    index = D.DatasetIndex(places, cache)
    assert not cache.has("gazetteer-10000") and cache.get("none") is None
    assert index.contains("Lusaka ") and not index.contains("lusak") and [r.name for r in index.suggest("n").collect()] == ["nairobi", "nairobi area"]
    assert D.DatasetCache(spark, str(tmp_path / "cache")).has("gazetteer-10000") and index.tagger().gazetteer["kenya"] == "COUNTRY"
    assert index.nearest(spark.createDataFrame([(1, -15.0, 28.0)], "p long, lat double, lon double"), "p", 1).first().city_id == 1
    assert G.contains(places.cities, "LUSAKA").first().found and not G.contains(places.cities, "x").first().found


def test_line_numbers(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 20)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"text": f"{name}{i}"}) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for name, n in (("a", 3000), ("b", 20)):
            got = S.jsonl_documents(spark, f"{tmp_path}/{name}.jsonl").collect()
            assert len(got) == n and all(r.id == f"jsonl-{r.text[1:]}" for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    many = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("text"))
    assert all(r.id == int(r.text) for r in S.sentiment_samples(many).collect())


@pytest.mark.parametrize("kind", ["string", "long", "date", "double"])
def test_ranked_on_ties_and_other_kinds(spark, kind):
    rows = [(i, (i * 7919) % 100, 5 if i % 2 else (i * 31) % 50) for i in range(1000)]
    d = spark.createDataFrame(rows, "i long, t long, v long")
    by = {"string": F.concat(F.lit("prefix-"), F.lpad(F.col("v").cast("string"), 3, "0")), "long": F.col("v"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("v").cast("int")), "double": F.when(F.col("v") == 7, None).otherwise(F.col("v") / 2)}[kind]
    for descending in (False, True):
        got = {r.i: (r.rn, r.s) for r in ranked(d, by, ["t", "i"], descending, sums={"s": F.col("t")}, buckets=16).collect()}
        null = lambda v: kind == "double" and v == 7
        order = sorted(rows, key=lambda r: (((not null(r[2]), r[2]) if not descending else (null(r[2]), -r[2])), r[1], r[0]))
        total = 0
        for n, (i, t, _) in enumerate(order, 1):
            total += t
            assert got[i] == (n, total)


def test_forests_use_all_rows(spark):
    r = np.random.default_rng(2)
    x = r.uniform(0, 1, (4000, 3))
    rows = [(i, [float(v) for v in a], int(a[1] > 0.37), float(10 * (a[2] > 0.61) + a[0] / 100)) for i, a in enumerate(x)]
    d = spark.createDataFrame(rows, "row_id long, features array<double>, label int, target double").repartition(5)
    m = models.RandomForestClassifier(20, max_features=3).fit(d)
    assert all(j == 1 and abs(cut - 0.37) < 0.01 for j, cut, *_ in m.state["stumps"]) and m.predict(d).where("prediction = label").count() > 3950
    g = models.RandomForestRegressor(20, max_features=3).fit(d)
    assert all(j == 2 and abs(cut - 0.61) < 0.01 for j, cut, *_ in g.state["stumps"])
    assert g.fit(d.repartition(2)).state == models.RandomForestRegressor(20, max_features=3).fit(d).state or np.allclose([s[1:] for s in g.state["stumps"]], [s[1:] for s in models.RandomForestRegressor(20, max_features=3).fit(d).state["stumps"]])
    same = spark.createDataFrame([(1, [1.0], 1, 2.0), (2, [1.0], 0, 4.0)], d.schema)
    assert models.RandomForestRegressor(5).fit(same).predict(same).count() == 2 and models.RandomForestClassifier(5).fit(same).predict(same).count() == 2
