"""The corpus pipeline: five stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import line_dedup, minhash, mixing, packing, quality
from loomspark.llm.common import DOC_COLUMNS, read, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps.

    Null and empty texts go, other nulls are carried. Long texts are scored whole, equal texts alike, so repeated rows stay or go
    together. No documents: no rows. Columns beyond those of documents are dropped.
    """
    return quality.classify(docs, columns=DOC_COLUMNS).select(*DOC_COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages are cut out of the texts. Documents of which nothing is left go.

    Null and empty texts and rows without a doc_id pass as they are. Long texts are cut whole. Repeated rows are one document
    given twice and both stay. No documents: no rows. Columns beyond those of documents are dropped.
    """
    return line_dedup.dedup_lines(docs).where("n_removed = 0 or length(trim(text)) > 0").select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id.

    Null texts, texts without words and rows without a doc_id stay. Long texts are compared whole. Of repeated rows one stays. No
    documents: no rows. Columns beyond those of documents are dropped.
    """
    return minhash.keep_one(docs.select(*DOC_COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token blocks that the mixture of sources takes.

    Null and empty texts go; a null source is a source of its own and a null doc_id an id. A long text fills several blocks and
    is taken with its first. Repeated rows stay or go together. No documents: no rows. Columns beyond those of documents are dropped.
    """
    return mixing.mix_sources(docs).select(*DOC_COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences, by exact tokens.

    Null and empty texts have no row; a document without an id is packed without one. Long texts are cut into pieces. Repeated
    rows are packed once each. No documents: no rows. Other columns are ignored.
    """
    return packing.pack_tokens(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit),
]

# the classifier is trained, signatures are hashed in Python and packing is sequential: not for SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
