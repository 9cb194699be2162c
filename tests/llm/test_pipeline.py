import random

import corpus_pipeline
import pytest

from loomspark.llm import queries
from loomspark.llm.common import DOC_COLUMNS

from .conftest import edge_rows


def clean_text(r, n):
    word = lambda: "".join(r.choice(("an", "the", "or", "sta", "ing", "rel", "mo", "ti", "ka", "lo")) for _ in range(r.randint(1, 4)))
    return "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))


@pytest.fixture
def folder(documents, tmp_path):
    def write(rows):
        documents(rows).write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        return str(tmp_path)

    return write


def test_each_stage_decides_and_keeps_the_columns(spark, folder):
    r = random.Random(14)
    texts = [clean_text(r, r.randint(4, 20)) for _ in range(200)]
    rows = [(i, t, r.choice("ab")) for i, t in enumerate(texts)]
    junk = [(1000 + i, " ".join(w + "***" for w in t.split()), "a") for i, t in enumerate(texts[:40])]
    near = [(2000 + i, t.replace("\n", " ").replace(t.split()[3], "changed", 1), "b") for i, t in enumerate(texts[:30])]
    passage = [(3000 + i, clean_text(r, 5) + "\n" + texts[i], "a") for i in range(30)]
    sf = folder(rows + junk + near + passage)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert sorted(out.columns) == sorted(DOC_COLUMNS)
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept[k] = {x.doc_id: x for x in out.collect()}
    first = {i for i, _, _ in rows}
    assert len(first & kept[0].keys()) > 195 and not {i for i, _, _ in junk} & kept[0].keys()
    cut = [kept[1][3000 + i].text for i in range(30) if 3000 + i in kept[1]]
    assert len(cut) > 25 and all(t.count("\n") == 4 for t in cut)
    assert len({2000 + i for i in range(30)} & kept[2].keys()) <= 3 and len(first & kept[2].keys()) > 190
    assert 0 < len(kept[3]) < len(kept[2]) and kept[3].keys() <= kept[2].keys()
    assert kept[4].keys() == kept[3].keys()


def test_run_and_edges(spark, folder):
    out = corpus_pipeline.run(spark, folder(edge_rows()))
    assert out.columns == ["shard", "bin", "bin_offset", "doc_id", "piece", "start", "n_tokens"]
    got = out.collect()
    # the long text repeats itself and may be rejected; null and empty texts have no place, repeated rows at most one
    assert {x.doc_id for x in got} <= {1, None, 4, 5, 6, 7, 8, 9} and 1 in {x.doc_id for x in got} and sum(x.doc_id == 7 for x in got) <= 1
    assert corpus_pipeline.run(spark, folder([])).collect() == []


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
