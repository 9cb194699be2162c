import random

import numpy as np
import pyarrow as pa

from loomspark.llm.fingerprints import _BASE, _RUN, coin_labels, fingerprint, fingerprints
from loomspark.llm.kernels import mix, string_parts

from .conftest import edge_rows

M = (1 << 64) - 1


def mix1(x):
    return int(mix(np.array([x & M], np.uint64))[0])


def toss(x, y):
    d = x ^ y
    k = (d & -d).bit_length() - 1
    return 2 * k + (x >> k & 1)


def brute(text, levels):
    """One symbol at a time."""
    names = [mix1(b + 1) for b in text.encode()]
    for _ in range(levels):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix1(x + n * int(_RUN)) for x, n in runs]
        label = names
        for _ in range(4):
            label = [toss(x, label[i - 1] if i else x ^ 1) for i, x in enumerate(label)]
        cuts = [i for i in range(len(names)) if i == 0 or (label[i] > label[i - 1] and label[i] > (label[i + 1] if i + 1 < len(label) else 0))]
        groups = [names[a:b] for a, b in zip(cuts, [*cuts[1:], len(names)])]
        names = [mix1(sum(mix1(x) * pow(_BASE, k, 1 << 64) for k, x in enumerate(g)) + len(g)) for g in groups]
    return names


def test_matches_brute_force():
    r = random.Random(8)
    texts = ["".join(r.choice("aab cé\n") for _ in range(r.choice((0, 1, 2, 3, 7, 50, 400)))) for _ in range(60)]
    for levels in (1, 2, 4):
        names, _, of = fingerprint(*string_parts(pa.array(texts)), levels)
        for i, t in enumerate(texts):
            assert names[of[i] : of[i + 1]].tolist() == brute(t, levels)


def test_labels_are_small_and_differ_from_their_neighbours():
    names = mix(np.arange(10_000, dtype=np.uint64))
    first = np.zeros(len(names), bool)
    first[::97] = True
    label = coin_labels(names, first)
    assert label.max() < 6
    assert (label[1:] != label[:-1])[~first[1:]].all()


def test_equal_substrings_share_interior_names_at_any_offset():
    r = random.Random(9)
    line = lambda n: "".join(r.choice("etaoin shrdlu") for _ in range(n))
    passage = line(3000)
    texts = [line(k) + passage + line(5 * k) for k in (0, 1, 2, 3, 50, 333)]
    names, begin, of = fingerprint(*string_parts(pa.array(texts)), 4)
    inside = []
    for i, k in enumerate((0, 1, 2, 3, 50, 333)):
        rows = range(of[i], of[i + 1])
        at = sum(map(len, texts[:i])) + k
        inside.append([(int(begin[j]) - at, int(names[j])) for j in rows if at + 500 <= begin[j] < at + 2400])
    assert len(inside[0]) > 20 and all(x == inside[0] for x in inside)


def test_edges(documents):
    rows = fingerprints(documents(edge_rows(), extra=True)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].whole is None and by[2][0].phrases is None
    assert by[3][0].phrases == [] and by[3][0].whole is not None
    assert len(by[7]) == 2 and by[7][0] == by[7][1] and len(by[None]) == 2
    assert len(by[5][0].phrases) > 500
    assert fingerprints(documents([])).collect() == []


def test_passages_of_fifty_words_share_names(documents):
    r = random.Random(10)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [prose(50) for _ in range(60)]
    texts = [f"{prose(r.randint(20, 200))} {p} {prose(r.randint(20, 200))}" for p in passages for _ in range(2)]
    rows = {x.doc_id: x for x in fingerprints(documents(enumerate(texts))).collect()}
    for i in range(0, len(texts), 2):
        assert set(rows[i].phrases_4) & set(rows[i + 1].phrases_4), passages[i // 2]
        assert len(set(rows[i].phrases_3) & set(rows[i + 1].phrases_3)) >= 5
    for i, t in enumerate(texts[:4]):
        for level, got in ((3, rows[i].phrases_3), (4, rows[i].phrases_4), (5, rows[i].phrases)):
            assert [x & M for x in got] == brute(t, level)


def test_finer_levels_of_edges(documents):
    by = {r.doc_id: r for r in fingerprints(documents(edge_rows())).collect()}
    assert by[2].phrases_3 is None and by[2].phrases_4 is None
    assert by[3].phrases_3 == [] and by[3].phrases_4 == []
