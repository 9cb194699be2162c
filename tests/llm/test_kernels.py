import random
import re

import numpy as np
import pyarrow as pa

from loomspark.llm import kernels as K


def test_words_and_hashes_match_a_scan():
    r = random.Random(1)
    texts = ["".join(r.choice("ab é.Z9 \n-") for _ in range(r.randint(0, 60))) for _ in range(200)] + ["", "x", None]
    raw, offsets = K.string_parts(pa.array(texts, pa.string()))
    starts, ends, first = K.words(raw, offsets)
    h = K.span_hashes(raw, starts, ends)
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        expected = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())
        got = [raw[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == expected
        for w, x in zip(got, h[first[i] : first[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_pieces_cover_every_row_once():
    column = pa.array(["a" * n for n in (0, 5, 3_000_000, 1, 0)] + ["b"] * 3000)
    rows = [(a, b) for a, b, _, _ in K.pieces(column)]
    assert rows[0][0] == 0 and rows[-1][1] == len(column)
    assert all(x[1] == y[0] for x, y in zip(rows, rows[1:]))
    assert sum(len(raw) for _, _, raw, _ in K.pieces(column)) == 3_000_006 + 3000
    assert list(K.pieces(pa.array([], pa.string()))) == []


def test_slices_and_large_strings():
    column = pa.array(["aa", "b", "cc", None, "d"], pa.large_string()).slice(1, 4)
    raw, offsets = K.string_parts(column)
    assert raw.tobytes() == b"bccd" and offsets.tolist() == [0, 1, 3, 3, 4]
    assert K.sums(np.array([1, 2, 3, 4]), offsets).tolist() == [1, 5, 0, 4]
