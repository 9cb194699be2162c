"""Queries: JSON fields, guarded SQL, expressions, routing, dictionaries and stores."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import providers as P
from ..operators import retrieval as R
from ..sources import readers as S
from ..sources import stores as K
from ..workers import shared_folder
from .tabular import r6, read


def extract_props(spark, sf):
    m = read(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return m.select("event_id", F.explode("m").alias("name", "value"))


def guarded_sql(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    g = A.GuardedSql(spark, ["orders"], {"orders": ["o_orderstatus", "o_totalprice", "o_orderkey"]})
    return g.frame("select o_orderstatus, count(o_orderkey) as n, max(o_totalprice) as top from orders where o_totalprice > :least group by o_orderstatus", {"least": 1000.0})


def expression_eval(spark, sf):
    c = A.expression_column("sqrt(q) + pow(2, 3) * -d ^ 2 + max(q, p / 1000)", ("q", "d", "p"))
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("p"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p", r6(c).alias("value"))


def tool_routing(spark, sf):
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", A.route_column("text").alias("tool"))


def sql_documents(spark, sf):
    read(spark, sf, "benchmark").createOrReplaceTempView("loom_benchmark")
    d = S.sql_documents(spark, "select item_id as id, text, 'benchmark' as topic from loom_benchmark where length(text) >= :least", params={"least": 10})
    return d.select("id", F.md5("text").alias("digest"), F.col("metadata")["topic"].alias("topic"))


def dictionary_merge(spark, sf):
    p = read(spark, sf, "part").select(F.upper("p_name").alias("w"), "p_brand", "p_type")
    d = S.dictionary(p, "w", ["p_brand", "p_type"])
    return S.phrase_map(d).select("word", F.array_join(F.array_sort("translations"), "|").alias("translations"))


def store_upsert(spark, sf):
    """Customers with balances below zero replace what the store has of them."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), "c_acctbal", "c_nationkey")
    old = c.select("id", "text", F.lit("old").alias("state"))
    new = c.where("c_acctbal < 0").select("id", "text", F.lit("new").alias("state"))
    return K.upsert(old, new)


def echo_answers(spark, sf):
    """The stand-in model over every conversation turn: its prefix and 240 characters, in pieces of 40."""
    model = P.EchoModel()

    @F.pandas_udf("array<string>")
    def said(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(model.stream(t or "")))

    return read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(said("text")).alias("nth", "piece"))


def query_expansion(spark, sf):
    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        return s.map(R.expand_query)

    b = read(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(forms("text")).alias("nth", "q")).select("item_id", "nth", F.md5("q").alias("digest"))


def prompt_lengths(spark, sf):
    """The question-answering prompt for each benchmark item with itself as context."""
    q = F.lit(R.qa_prompt("?", ["\x01"]))
    return read(spark, sf, "benchmark").select("item_id", F.md5(F.replace(q, F.lit("\x01"), F.col("text"))).alias("digest"))


def _written(spark, table, fmt, **options):
    path = f"{shared_folder(spark)}/given-{uuid.uuid4().hex}"
    table.write.format(fmt).options(**options).save(path)
    return path


def csv_rows(spark, sf):
    """Customers through a CSV file and its reader."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias(" c_custkey "), "c_name", F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("c_mktsegment"))
    return S.csv_table(spark, _written(spark, c, "csv", header=True, escape="\\"))


def json_rows(spark, sf):
    """Orders as JSON arrays and back."""
    o = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_custkey")))).alias("value"))
    path = f"{shared_folder(spark)}/given-{uuid.uuid4().hex}"
    o.write.partitionBy("o_orderstatus").text(path)  # a file holds one array
    return S.json_table(spark, path, "o_orderkey long, o_custkey long").select("o_orderkey", "o_custkey")


def jsonl_rows(spark, sf):
    """Benchmark items as lines of one JSON file without ids; each gets its line's number."""
    b = read(spark, sf, "benchmark").select("text", F.col("item_id").cast("string").alias("item"))
    path = _written(spark, b.orderBy("item").coalesce(1), "json")
    d = S.jsonl_documents(spark, path)
    return d.select("id", F.md5("text").alias("digest"), F.col("metadata")["item"].alias("item"))


def text_files(spark, sf):
    """Nations as text files of a folder, one each."""
    n = read(spark, sf, "nation").select("n_name", F.concat("n_name", F.lit(" in region "), F.col("n_regionkey").cast("string")).alias("value"))
    path = f"{shared_folder(spark)}/given-{uuid.uuid4().hex}"
    n.write.partitionBy("n_name").text(path)
    d = S.directory_documents(spark, path)
    return d.select(F.trim("text", F.lit("\n")).alias("text"), F.startswith("id", F.lit("file:")).alias("named"))


def store_search(spark, sf):
    """Embeddings put into a folder store twice, the second time changed, and searched."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("text"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    store = K.FolderVectorStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").upsert(e)
    store.upsert(e.where("text = '1'").withColumn("vector", F.transform("vector", lambda x: -x)))
    found = store.search(_V, 10)
    return found.select("id", "text", r6("score").alias("score"))


def index_saved(spark, sf):
    """A vector index saved and loaded."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    K.save_index(read(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("n")), path)
    return K.load_index(spark, path)


def text_ids(spark, sf):
    """Regions' names as texts in memory."""
    names = [r.r_name for r in read(spark, sf, "region").orderBy("r_regionkey").collect()]  # a table of fixed size
    return S.text_documents(spark, names).select("id", "text")


def sentiment_rows(spark, sf):
    """Labelled samples without ids or labels get their position and 'negative'."""
    b = read(spark, sf, "benchmark").orderBy("item_id").select("text", F.when(F.col("item_id") % 2 == 0, "positive").alias("label"))
    return S.sentiment_samples(b).select("id", F.md5("text").alias("digest"), "label")


_V = [((5 * i) % 11 - 5) / 10 for i in range(64)]
QUERIES = {f.__name__: f for f in (extract_props, guarded_sql, expression_eval, tool_routing, sql_documents, dictionary_merge, store_upsert, csv_rows, json_rows, jsonl_rows, text_files, store_search, index_saved, text_ids, sentiment_rows, echo_answers, query_expansion, prompt_lengths)}

_VEC = "cast([" + ", ".join(map(str, _V)) + "] as double[])"
ORACLE_SQL = {
    "extract_props": "select event_id, k as name, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) k from events)",
    "guarded_sql": "select o_orderstatus, count(o_orderkey) as n, max(o_totalprice) as top from orders where o_totalprice > 1000.0 group by o_orderstatus",
    "expression_eval": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as p, round(sqrt(l_quantity) + 8 * pow(-l_discount, 2) + greatest(l_quantity, l_extendedprice / 1000), 6) as value from lineitem",
    "tool_routing": rf"select conv_id, turn, case when regexp_matches(lower(text), '{A._MATH}') then 'math' when regexp_matches(lower(text), 'weather|temperature') then 'weather' when regexp_matches(lower(text), 'sql|database|db |orders|customers') then 'db_query' else 'rag_qa' end as tool from conversations where role = 'user'",
    "sql_documents": "select cast(item_id as varchar) as id, md5(text) as digest, 'benchmark' as topic from benchmark where length(text) >= 10 and trim(text) <> ''",
    "dictionary_merge": "select lower(trim(p_name)) as word, array_to_string(list_sort(list_distinct(flatten(list([p_brand, p_type])))), '|') as translations from part group by 1 having len(string_split(word, ' ')) between 2 and 5",
    "store_upsert": "select cast(c_custkey as varchar) as id, c_name as text, case when c_acctbal < 0 then 'new' else 'old' end as state from customer",
    "echo_answers": "select conv_id, turn, cast(st // 40 as int) as nth, substr(a, cast(st + 1 as bigint), 40) as piece from (select conv_id, turn, a, unnest(range(0, length(a), 40)) st from (select conv_id, turn, 'Echo: ' || substr(text, 1, 240) a from conversations))",
    "query_expansion": "select item_id, cast(i as int) as nth, md5(case i when 0 then text when 1 then text || ' explanation' else 'about ' || text end) as digest from benchmark, range(3) t(i)",
    "prompt_lengths": """select item_id, md5(concat_ws(chr(10), 'Answer from the context alone.', '', 'Context:', '[1] ' || text, '', 'Question: ?', 'Answer:')) as digest from benchmark""",
    "csv_rows": "select cast(c_custkey as varchar) as c_custkey, c_name, case when c_nationkey > 3 then c_mktsegment else '' end as c_mktsegment from customer",
    "json_rows": "select o_orderkey, o_custkey from orders",
    "jsonl_rows": "select 'jsonl-' || (row_number() over (order by cast(item_id as varchar)) - 1) as id, md5(text) as digest, cast(item_id as varchar) as item from benchmark",
    "text_files": "select n_name || ' in region ' || n_regionkey as text, true as named from nation",
    "store_search": f"""with v as (select cast(vec_id as varchar) as id, cast(label as varchar) as text, [case when label = 1 then -x else x end for x in cast(embedding as double[])] v from embeddings)
        select id, text, round(list_cosine_similarity(v, {_VEC}), 6) as score from v order by list_cosine_similarity(v, {_VEC}) desc, id limit 10""",
    "index_saved": "select vec_id, label, cast(len(embedding) as int) as n from embeddings",
    "text_ids": "select 'text-' || r_regionkey as id, r_name as text from region",
    "sentiment_rows": "select row_number() over (order by item_id) - 1 as id, md5(text) as digest, case when item_id % 2 = 0 then 'positive' else 'negative' end as label from benchmark",
}
