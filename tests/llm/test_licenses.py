import math
import random
import textwrap

import duckdb
import pytest

from loomspark.llm import licenses as L

from .conftest import edge_rows


def brute(rows, templates, threshold):
    """All runs of lines of a paragraph, then those that hold no other."""
    out = set()
    for i, text, *_ in rows:
        lines = [] if text is None else [L.words_of(line) for line in text.split("\n")]
        for name, notice in templates.items():
            notice = L.Notice(notice) if isinstance(notice, str) else notice
            t, names, others = map(L.words_of, (notice.text, notice.names, notice.others))
            need, hits = math.ceil(threshold * len(t) - 1e-9), []
            for a in range(len(lines)):
                have = set()
                for b in range(a, len(lines)):
                    if not lines[b]:
                        break
                    have |= lines[b]
                    if len(have & t) >= need and names <= have:
                        hits.append((a, b, len(have & t), bool(have & others)))
            out |= {(i, a, b, name, n, round(n / len(t), 6)) for a, b, n, bad in hits if not bad and not any(a <= c and d <= b and (c, d) != (a, b) for c, d, _, _ in hits)}
    return out


def test_matches_brute_force(documents):
    r = random.Random(13)
    letters = "abcdefghijklmnop"
    templates = {f"t{k}": L.Notice(" ".join(r.sample(letters, r.randint(1, 9))), r.choice(["", "", "a", "b q"]), r.choice(["", "", "c", "r"])) for k in range(12)}
    rows = [(i, "\n".join(" ".join(r.choice(letters + "qrs") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 9)))) for i in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        got = [tuple(x) for x in L.scan(documents(rows), templates, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, templates, threshold)


@pytest.mark.parametrize("extra", [False, True])
def test_notices_and_edges(documents, extra):
    rows = edge_rows() + [(60, "text\n(c) X. Licensed under the APACHE License, Version 2.0!\nmore"), (61, "Licensed under CC-BY-NC 4.0"), (62, "the license of the work is under version"), (None, "Released under the MIT License."), (63, "Licensed under CC BY 4.0."), (64, "x " * 500_000 + "Released under the MIT License")]
    got = {tuple(x) for x in L.scan(documents(rows, extra), L.TEMPLATES).collect()}
    assert got == brute(rows, L.TEMPLATES, L.THRESHOLD)
    assert {(i, name) for i, _, _, name, _, c in got if c == 1} == {(60, "Apache-2.0"), (61, "CC-BY-NC-4.0"), (None, "MIT"), (63, "CC-BY-4.0"), (64, "MIT")}
    assert L.scan(documents([])).collect() == [] and L.scan(documents(rows), {}).collect() == []


def test_a_notice_that_names_another_is_not_found(documents):
    rows = [(1, "Released under the Apache license."), (2, "Licensed under CC BY-NC 4.0."), (3, "GNU Lesser General Public License, version 3. This work is licensed under the")]
    assert {(x.doc_id, x.license) for x in L.scan(documents(rows)).collect()} == {(2, "CC-BY-NC-4.0")}


def test_wrapped_notices(documents, spark, tmp_path):
    wrap = lambda k, width, mark: "x\n\n" + "\n".join(mark + line for line in textwrap.wrap(L.TEMPLATES[k].text, width)) + "\n\ny"
    cases = [(k, width, mark) for k in L.TEMPLATES for width, mark in ((30, "# "), (72, " * "), (80, ""))]
    rows = [(i, wrap(*c)) for i, c in enumerate(cases)]
    got = {tuple(x) for x in L.scan(documents(rows)).collect()}
    assert got == brute(rows, L.TEMPLATES, L.THRESHOLD)
    assert {(i, name) for i, _, _, name, _, _ in got} >= {(i, k) for i, (k, _, _) in enumerate(cases)}
    documents(rows).toPandas().to_parquet(tmp_path / "d.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
        assert set(c.execute(L.ORACLE).fetchall()) == got
