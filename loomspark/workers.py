"""Python workers must find this package, and all executors a folder."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> None:
    """Put the package's folder on the path of the session's Python workers (it must be there on every machine, or be shipped)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])


SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20  # what a worker holds as Python objects at once


def release() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a text array that are few and short enough to be Python objects; a longer text is a range of its own."""
    first = held = 0
    for i, n in enumerate(pa.compute.binary_length(text).to_pylist()):
        if i > first and (held + (n or 0) > SLICE_BYTES or i - first >= SLICE_ROWS):
            yield first, i
            first, held = i, 0
        held += n or 0
    if len(text):
        yield first, len(text)


def by_slices(run: Callable[[list], pa.Array], kind: str, text: Column) -> Column:
    """A column of ``kind``: ``run`` makes an Arrow array of a list of texts, a slice of each batch at a time."""

    def lean(texts: pa.Array) -> pa.Array:
        made = [run(texts[a:b].to_pylist()) for a, b in slices(texts)]
        out = pa.concat_arrays(made) if made else run([])
        del made
        release()
        return out

    return F.arrow_udf(lean, kind)(text)


def rows_by_slices(df: DataFrame, key: str, text: str, run: Callable[[list, list], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that ``run`` makes of keys and texts, a slice of each batch at a time."""
    ready(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for i, j in slices(b.column(1)):
                    yield run(b.column(0)[i:j].to_pylist(), b.column(1)[i:j].to_pylist())
        finally:
            release()

    return df.select(key, text).mapInArrow(lean, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh one in a local session where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder
