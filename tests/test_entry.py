import importlib
import sys

import __spark_entry__ as entry
import pytest

from loomspark.plans import catalog


def test_registry():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert queries.keys() <= entry.queries().keys() and set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("loomspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loomspark.llm", None)
    fresh = importlib.reload(entry)
    assert fresh.queries().keys() == catalog.queries().keys()


@pytest.fixture
def empty(spark, tmp_path):
    """All tables without a row."""
    schema = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "labels": "doc_id long, quality int, toxic int",
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string",
    }
    for name, s in schema.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_empty_tables(spark, empty):
    for name in ("words_ngrams", "rake_keywords", "ner_entities", "bm25_search", "tfidf_weights", "hash_embed", "chunk_words", "explorer_chunks", "lang_detect", "tool_routing", "bootstrap", "stratified_fold"):
        assert catalog.queries()[name](spark, empty).collect() == [], name
    assert catalog.queries()["roc_auc"](spark, empty).first().roc_auc == 0
