"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for the small tables that loops rewrite."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def token_estimate(text: Column) -> Column:
    """Four bytes a token, rounded up: the usual size estimate when no exact count is at hand. Null for null."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def release() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path; a worker gives its memory back at the end of a task."""
    ready(df.sparkSession)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def text_score(df: DataFrame, score, column: str, name: str) -> DataFrame:
    """df with ``name``, a double that ``score`` gives for each Arrow array of ``column``; only that column goes to Python and only the numbers come back."""
    ready(df.sparkSession)

    def lean(text: pa.Array) -> pa.Array:
        out = score(text)
        release()
        return out

    # as if not deterministic, or a later filter would make Spark evaluate it twice
    return df.withColumn(name, F.arrow_udf(lean, "double").asNondeterministic()(F.col(column)))
