from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, extra: bool = False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that the operators use themselves
            for name in ("pos", "shard", "block", "score", "sig", "key", "n_tokens", "th", "gone", "a", "b", "line", "w", "src", "draw", "quota", "available", "count"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return build


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "\n".join(f"line {i} of a very long text about nothing at all" for i in range(4000))
    return [
        (1, "one two three four five six\nsecond line here\nthird line here\nfourth"),
        (2, None),
        (None, "text without an id\nwith lines\nand more lines\nand more"),
        (3, ""),
        (4, "   \n\n\n  \n"),
        (5, long),
        (6, "one two three four five six\nsecond line here\nthird line here\nother"),
        (7, "same row"),
        (7, "same row"),
        (8, "word"),
        (9, "ünïcödé ñandú straße 東京 😀 text", None),
        (None, None),
    ]
