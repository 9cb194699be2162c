"""Streams: tokens of an answer, and an incremental index over arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def stream_answers(prompts: DataFrame, generate: Callable[[str], str], key: str, text: str = "text", size: int = 40) -> DataFrame:
    """key, nth, piece: a stream (or table) of prompts answered and cut into pieces."""
    import pandas as pd

    kind = dict(prompts.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                answer = generate(t or "")
                rows += [(k, i // size, answer[i : i + size]) for i in range(0, len(answer), size)]
            yield pd.DataFrame(rows, columns=[key, "nth", "piece"])

    return prompts.select(key, text).mapInPandas(run, f"`{key}` {kind}, nth int, piece string")


def index_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id"):
    """Appends the term counts of arriving documents to a Parquet index; exactly once, by the sink's own log."""
    terms = docs.select(key, T.lower_words("text", r"[\p{L}\p{N}]+").alias("ws"))
    rows = terms.select(key, F.size("ws").alias("length"), F.explode(F.array_distinct("ws")).alias("term"), "ws").select(key, "length", "term", F.size(F.filter("ws", lambda x: x == F.col("term"))).alias("tf"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
