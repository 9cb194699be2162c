import json
import math

import pytest
from pyspark.sql import functions as F

from loomspark.operators import agents as A
from loomspark.operators import geo as G
from loomspark.operators import vision as V
from loomspark.operators.base import InvalidArgument
from loomspark.sources import readers as S
from loomspark.sources import stores as K


@pytest.fixture
def geo(spark):
    countries = spark.createDataFrame([("Zambia", "ZM", "ZMB", "260"), ("Kenya", "KE", "KEN", "+254")], "name string, iso2 string, iso3 string, phone_code string")
    states = spark.createDataFrame([("Lusaka Province", "09", "ZM")], "name string, state_code string, iso2 string")
    places = spark.createDataFrame([("ZM", "Zambia", -15.0, 30.0)], "cca2 string, name string, lat double, lon double")
    cities = spark.createDataFrame([(1, "Lusaka", "ZM", "09", -15.4167, 28.2833), (2, "Nairobi", "KE", "30", -1.286389, 36.817223)], "city_id int, name string, country_code string, state_code string, lat double, lon double")
    return G.Geo(countries, states, places, cities)


def test_geo(spark, geo):
    assert geo.country("ZM").first().name == "Zambia" == geo.country("zambia").first().name and geo.states_of("ZM").first().state_code == "09"
    p = spark.createDataFrame([(5, -15.4167, 28.2833), (6, -1.2, 36.8)], "k int, lat double, lon double")
    near = {x.k: (x.city_id, x.distance_km) for x in geo.nearest_cities(p, "k", 1).collect()}
    assert near[5] == (1, 0.0) and near[6][0] == 2
    assert geo.nearest_cities(p, "k", 5, within_km=100).count() == 2 and geo.nearest_cities(p, "k", 1, country="ke").where("k = 5").first().city_id == 2
    assert geo.search_place("Luska").first().type == "CITY"
    assert {x.k: x.iso2 for x in geo.country_of(p, "k").collect()} == {5: "ZM", 6: "KE"}
    c = {x.iso2: (x.lat, x.lon) for x in geo.centroids().collect()}
    assert c == {"ZM": (-15.0, 30.0), "KE": (-1.286389, 36.817223)}
    assert dict(geo.gazetteer().collect()) == {"zambia": "COUNTRY", "kenya": "COUNTRY", "lusaka province": "STATE", "lusaka": "CITY", "nairobi": "CITY"}
    assert dict(geo.country_phone_index().collect()) == {"260": "ZM", "254": "KE"} and [x.name for x in G.suggest(geo.cities, "lu").collect()] == ["Lusaka"]
    f = {x.k: x.features for x in G.geo_features(geo, p, "k").collect()}
    assert f[5] == [-15.4167, 28.2833, 0.0, (90 + 77) / 200]
    km = spark.range(1).select(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("x")).first().x
    assert abs(km - math.pi * 6371) < 1e-6


def test_vision(spark, tmp_path):
    skin = [(1, i, 220.0, 160.0, 130.0) for i in range(3)] + [(1, i, 10.0, 10.0, 220.0) for i in (3, 4)]
    px = spark.createDataFrame(skin, "image_id int, pos int, r double, g double, b double")
    got = V.skin_ratio(px, 0.3, 0.7).first()
    assert got.skin_ratio == 0.6 and got.risk == "medium"
    assert V.analyze(px).first().palette[0].share == 0.6
    m = spark.createDataFrame([(1, [[[255.0, 0.0, 0.0]] * 2, [[0.0, 0.0, 300.0]] * 2])], "image_id int, matrix array<array<array<double>>>")
    out = V.from_matrix(m, most=3).collect()
    assert len(out) == 2 and max(x.b for x in out) == 255
    f = V.forensics(px).first()
    assert f.diversity == 0.4 and f.n == 5
    sig = spark.createDataFrame([(1.0, 1.0, False, 0.9, 0.01, 0.5), (0.0, 0.0, True, 0.1, 0.9, 0.0)], "generator_hint double, filename_hint double, has_camera boolean, flatness double, diversity double, clipping double")
    hi, lo = V.authenticity(sig).collect()
    assert hi.risk == "high" and lo.risk == "low" and lo.score == 0 and lo.confidence == 0.95
    (tmp_path / "a.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(x.r, x.b) for x in V.from_files(files).orderBy("pos").collect()] == [(255, 0), (0, 255)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" id ,English,\n1,house,x\n,,\n2,,y\n")
    d = S.csv_table(spark, f"{tmp_path}/a.csv")
    assert d.columns == ["id", "English", "_2"] and [tuple(x) for x in d.collect()] == [("1", "house", "x"), ("2", "", "y")]
    (tmp_path / "a.jsonl").write_text('{"id": "a", "text": "hello", "topic": "t"}\n\n{"text": " "}\n{"text": "two"}\n')
    j = S.jsonl_documents(spark, f"{tmp_path}/a.jsonl").collect()
    assert (j[0].id, j[0].metadata) == ("a", {"topic": "t"}) and len(j) == 2 and j[1].id.startswith("jsonl-")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.md").write_text("# hi\nthere")
    (tmp_path / "d" / "y.bin").write_text("no")
    (tmp_path / "d" / "z.txt").write_text("  ")
    assert [x.text for x in S.directory_documents(spark, f"{tmp_path}/d").collect()] == ["# hi\nthere"]
    (tmp_path / "o.json").write_text('[{"a": 1, "b": {"c": [true, null]}}]')
    assert S.json_table(spark, f"{tmp_path}/o.json").first().a == 1
    assert S.source_file(spark, f"{tmp_path}/o.json").first().text == "0.a: 1\n0.b.c.0: true\n0.b.c.1: "
    assert S.source_file(spark, f"{tmp_path}/a.csv").first().text == "id: 1, English: house, _2: x\nid: 2, English: , _2: y"
    with pytest.raises(PermissionError):
        S.source_file(spark, f"{tmp_path}/a.csv", ["/nowhere"])
    assert [x.id for x in S.text_documents(spark, ["a", "b"]).collect()] == ["text-0", "text-1"]
    spark.createDataFrame([("d1", "persistence layer", "persistence"), ("d2", "x", "evaluation")], "id string, text string, topic string").createOrReplaceTempView("docs_sql")
    got = S.sql_documents(spark, "select * from docs_sql where topic = :topic", params={"topic": "persistence"}).collect()
    assert [(x.id, x.metadata) for x in got] == [("d1", {"topic": "persistence"})]
    dic = S.dictionary(spark.createDataFrame([("House", "a", "b"), ("house", "b", "c"), ("big house", "z", None)], "w string, x string, y string"), "w", ["x", "y"])
    assert {x.word: x.translations for x in dic.collect()} == {"house": ["a", "b", "c"], "big house": ["z"]}
    assert S.word_map(dic).count() == 1 and S.phrase_map(dic).first().word == "big house"
    s = S.sentiment_samples(spark.createDataFrame([("good", "positive"), ("bad", None)], "text string, label string")).collect()
    assert [x.label for x in s] == ["positive", "negative"]
    i = {x.name: x.exists for x in S.integrity(spark, f"{tmp_path}/d/y.bin", ["y.bin", "gone"]).collect()}
    assert i == {"y.bin": True, "gone": False}


def test_stores(spark, tmp_path):
    items = spark.createDataFrame([("x", [0.1, 0.2], "hello", {"m": "1"})], K.ITEM)
    s = K.FolderVectorStore(spark, f"{tmp_path}/v").upsert(items).upsert(items.withColumn("text", F.lit("new")))
    again = K.FolderVectorStore(spark, f"{tmp_path}/v")
    assert [(x.id, x.text) for x in again.search([0.1, 0.2]).collect()] == [("x", "new")] and s.items.count() == 1
    m = K.MemoryVectorStore(spark).import_items(items)
    assert m.upsert(items).export_items().count() == 1
    K.append_audit(f"{tmp_path}/a.jsonl", {"a": 1})
    K.append_audit(f"{tmp_path}/a.jsonl", {"a": 2})
    assert len((tmp_path / "a.jsonl").read_text().splitlines()) == 2


@pytest.mark.parametrize(("text", "value"), [("sin(pi/2) + sqrt(144) + pow(2,3)", 21), ("3^2 + 4^2", 25), ("-2^2", 4), ("2^3^2", 512), ("10-4-3", 3), ("2*-3", -6), ("log(1000) + ln(e)", 4), ("max(1, min(5, 3)) / 2", 1.5), ("(1+2)*3", 9), ("1e3 + .5", 1000.5)])
def test_expressions(spark, text, value):
    assert A.evaluate(text) == pytest.approx(value)
    assert spark.range(1).select(A.expression_column(text).alias("x")).first().x == pytest.approx(value)


@pytest.mark.parametrize("text", ["1/0", "2 +", "(1", "foo(1)", "x", "1 2", "pow(1)", "", "ln(-1)"])
def test_bad_expressions(text):
    with pytest.raises(InvalidArgument):
        A.evaluate(text)


def test_guarded_sql(spark):
    spark.createDataFrame([(1, "Bela", 120.5, "s"), (2, "Ava", 45.25, "t")], "id int, customer string, amount double, secret_note string").createOrReplaceTempView("g_orders")
    log: list = []
    g = A.GuardedSql(spark, ["g_orders"], max_ms=600_000, audit=log.append)
    out = g.run("SELECT customer FROM g_orders WHERE amount > :least", {"least": 100.0})
    assert out["ok"] and out["rows"] == [{"customer": "Bela"}] and log[-1]["ok"]
    for bad in ("INSERT INTO g_orders VALUES (1)", "select 1; select 2", "select * from other", "", "select * from g_orders, other", "with x as (select 1 a) select * from x join other"):
        assert not g.run(bad)["ok"], bad
    p = A.GuardedSql(spark, ["g_orders"], {"g_orders": ["id", "amount"]}, max_ms=600_000)
    assert p.run("select id, amount + 1 as more from g_orders")["row_count"] == 2
    assert p.run("with x as (select id from g_orders) select id from x")["row_count"] == 2
    for bad in ("select * from g_orders", "select secret_note from g_orders", "select upper(secret_note) from g_orders", "select id from g_orders where secret_note = 's'", "with x as (select secret_note from g_orders) select 1 from x"):
        assert not p.run(bad)["ok"], bad
    assert A.GuardedSql(spark, max_rows=1, max_ms=600_000).run("select id from g_orders")["truncated"]
    assert not A.GuardedSql(spark, max_ms=0).run("select id from g_orders")["ok"]


def test_agents(spark):
    tools = A.standard_tools(sql=A.GuardedSql(spark), get=lambda u: f"got {u}", hosts=["ok.org"])
    out = A.RoutingAgent(tools).chat("what is 10+5?")
    assert out["answer"] == "Tool result: 15" and len(out["tool_calls"]) == 1
    said = iter([{"type": "tool_call", "tool": "math", "input": {"expression": "10+5"}}, {"type": "final", "content": "done"}])
    out = A.RoutingAgent(tools, lambda m, t: next(said)).chat("hi")
    assert out["answer"] == "done" and out["tool_calls"][0]["result"] == "15"
    assert "No answer" in A.RoutingAgent(tools, lambda m, t: {"type": "tool_call", "tool": "gone", "input": {}}, 2).chat("x")["answer"]
    assert A.call_tool('tool:math {"expression": "2*3"}', tools) == "6" and A.call_tool("tool:gone", tools).startswith("Unknown") and "math" in A.call_tool("help", tools)
    assert A.parse_decision('```json\n{"type":"tool_call","tool":"math","input":{"a":1}}\n```')["tool"] == "math" and A.parse_decision("text") == {"type": "final", "content": "text"}
    assert tools["free_api"].call({"url": "https://bad.org/x"}).startswith("host not allowed") and tools["weather"].call({"lat": 1, "lon": 2}) == "got weather?lat=1.0&lon=2.0"
    d = spark.createDataFrame([("2+2",), ("the weather",), ("my orders",), ("hello",)], "text string")
    assert [x.t for x in d.select(A.route_column("text").alias("t")).collect()] == ["math", "weather", "db_query", "rag_qa"]
    assert json.loads(tools["db_query"].call({"sql": "drop table x"}))["ok"] is False


def test_geo_files(spark, tmp_path):
    (tmp_path / "cs.json").write_text('[{"name": "Zambia", "iso2": "ZM", "iso3": "ZMB", "states": [{"name": "Lusaka Province"}]}]')
    (tmp_path / "c.json").write_text('[{"cca2": "ZM", "name": {"common": "Zambia"}, "latlng": [-15.0, 30.0]}]')
    (tmp_path / "t.json").write_text('[{"name": "Lusaka", "country_code": "ZM", "state_code": "09", "latitude": "-15.4167", "longitude": "28.2833"}, {"name": "X", "country_code": "ZM", "latitude": "?"}]')
    g = S.geo_tables(spark, *(f"{tmp_path}/{n}.json" for n in ("cs", "c", "t")))
    assert g.country("ZM").first().name == "Zambia" and g.states_of("Zambia").first().name == "Lusaka Province"
    assert g.cities_of("zm").first().lat == -15.4167 and g.centroids().first().lat == -15.0
