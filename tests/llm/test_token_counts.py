from pathlib import Path

import pytest
from tokenizers import Tokenizer

from loomspark.llm.token_counts import PATTERN, RANKS, count_tokens, encoder, tokenizer

from .conftest import edge_rows

pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="no vocabulary files")


def brute(text, rule):
    """By another library's offsets and a scan over sections."""
    tok = Tokenizer.from_file(str(Path(RANKS).with_name("byte_bpe_50k.json")))
    cuts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]]
    spans = list(zip(cuts, [*cuts[1:], len(text)]))
    n = [0] * len(spans)
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        hit = [i for i, x in enumerate(share) if x]
        n[hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda i: share[i])] += 1
    return [(i, s, e, x) for i, ((s, e), x) in enumerate(zip(spans, n))]


TEXTS = ["Hello world.\nSecond line\n\n\n  indented text\n", "a\n\n\nb", "Der Große Fluß\nñandú  \n\n   x", "one", "\n\n\n", "tab\t\n \n\t word's end\n"]


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_matches_brute_force(documents, rule):
    rows = count_tokens(documents(list(enumerate(TEXTS))), rule).collect()
    for i, text in enumerate(TEXTS):
        assert sorted((r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == i) == brute(text, rule)


def test_long_runs_encode_as_they_would():
    """Where the pattern's engine can still do it, against it; beyond, in linear time."""
    encode, plain = encoder(RANKS, PATTERN), tokenizer(RANKS, PATTERN)[0].encode_ordinary
    for n in (999, 1000, 1001, 3000):
        for ws in (" ", "\n", " \n\t", "\u3000 ", "\x85"):
            run = (ws * n)[:n]
            for a, b in (("a", "b"), ("", ""), ("x.", "é"), ("", "!"), ("z", "\x1cq"), ("a", " ")):
                text = a + run + b
                assert encode(text) == plain(text) and encode(text + "mid" + text) == plain(text + "mid" + text)
    for text in ("a" + " " * 2_000_000 + "b", "a" * 2_000_000, "a@" * 1_000_000, "\n" * 2_000_000):
        assert tokenizer(RANKS, PATTERN)[0].decode(encode(text)) == text


def test_edges(documents):
    rows = count_tokens(documents(edge_rows() + [(30, "a" * 200_000), (31, "a" + " " * 1_000_000 + "b")], extra=True)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert 2 not in by and [(r.section, r.start, r.end, r.n_tokens) for r in by[3]] == [(0, 0, 0, 0)]
    assert len(by[7]) == 2 and len(by[5]) == 4000 and None in by and len(by[30]) == len(by[31]) == 1
    assert all(r.end == len(edge_rows()[10][1]) for r in by[9])
    assert count_tokens(documents([])).collect() == []
    with pytest.raises(ValueError):
        count_tokens(documents([]), "middle")
