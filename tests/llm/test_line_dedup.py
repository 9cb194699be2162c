import random

from loomspark.llm.line_dedup import dedup_lines

from .conftest import edge_rows


def brute(rows):
    texts = {(i, t): t.split("\n") for i, t in rows if i is not None and t is not None}
    order = sorted(texts, key=lambda k: k[0])
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        ls = texts[k]
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if all(x.strip(" ") == "" for x in w):
                continue
            if w in seen:
                gone[k] |= {p, p + 1, p + 2}
            seen.add(w)
    return {k[0]: "\n".join(x for p, x in enumerate(texts[k]) if p not in gone[k]) for k in order}


def test_matches_brute_force(documents):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for i in range(120)]
    got = {x.doc_id: x.text for x in dedup_lines(documents(rows)).collect()}
    assert got == brute(rows)


def test_passage_is_cut_from_later_documents_only(documents):
    passage = "p one\np two\np three\np four"
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\nd\n{passage}"), (3, "e\nf\ng")]
    got = {x.doc_id: (x.text, x.n_chars, x.n_removed) for x in dedup_lines(documents(rows)).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1]), 0), 2: ("c\nd", 3, 4), 3: ("e\nf\ng", 5, 0)}


def test_edges(documents):
    rows = edge_rows() + [(5, "a\nb\nc"), (20, "a\nb\nc"), (21, "\n\n\n"), (22, "\n\n\n")]
    out = dedup_lines(documents(rows, extra=True))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_removed"]
    got = [(x.doc_id, x.text, x.n_removed) for x in out.collect()]
    assert len(got) == len(rows)
    # equal rows are one document; rows of one id and two texts are two; a wholly repeated document is left empty
    assert got.count((7, "same row", 0)) == 2 and (5, "a\nb\nc", 0) in got and (20, "", 3) in got
    assert (None, edge_rows()[2][1], 0) in got and (2, None, 0) in got
    assert (21, "\n\n\n", 0) in got and (22, "\n\n\n", 0) in got
    assert dedup_lines(documents([])).collect() == []
