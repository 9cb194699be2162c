"""Removal of repeated passages by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS

W = 3


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's own hash, and two independent hashes of each line. Only rows that can hold a window."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("ls"))
    lines = lines.where(F.size("ls") >= W)
    both = F.transform("ls", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) == "").alias("e")))
    return lines.select("doc_id", "th", both.alias("h"))


def windows(docs: DataFrame) -> DataFrame:
    """One row for each window of three consecutive lines that are not all blank: k1, k2 (its name), doc_id, th, pos."""
    h = F.col("h")
    at = lambda i, k: F.get(h, i + k)
    name = F.transform(
        F.sequence(F.lit(0), F.size(h) - W),
        lambda i: F.when(
            ~(at(i, 0)["e"] & at(i, 1)["e"] & at(i, 2)["e"]),
            F.struct(
                F.xxhash64(at(i, 0)["a"], at(i, 1)["a"], at(i, 2)["a"]).alias("k1"),
                F.xxhash64(at(i, 0)["b"], at(i, 1)["b"], at(i, 2)["b"]).alias("k2"),
            ),
        ),
    )
    return _hashed(docs).select("doc_id", "th", F.posexplode(name).alias("pos", "w")).where("w is not null").select("w.k1", "w.k2", "doc_id", "th", "pos")


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, th, and the positions (from 0) of the lines to remove, sorted and distinct.

    A window that occurs more than once keeps its first occurrence (least doc_id, th, pos); every line of every later one is
    covered, also where windows overlap. The windows are made twice rather than shuffled once as they are: counts are summed
    before the shuffle, so a window that a third of all documents share is a row a task there, and in the join with the
    first occurrences the skewed side is split.
    """
    w = windows(docs)
    first = w.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "pos")).alias("f")).where("c > 1")
    later = w.join(first.select("k1", "k2", "f"), ["k1", "k2"]).where("not (doc_id = f.doc_id and th = f.th and pos = f.pos)")
    spans = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.array(p, p + 1, p + 2)))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(spans)).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of documents with repeated passages removed from text, n_chars brought up to date, and n_removed lines.

    A document that loses all its lines keeps its row, with empty text. Fewer than three lines hold no window: unchanged. Lines
    are compared by two independent hashes, 96 bits in all. Windows of blank lines only don't count. A text of any length is one row. A null text or doc_id passes through unchanged. Rows
    with equal doc_id and text are one document given twice: they don't make a window repeated beyond its first
    place, and get the same result; rows with equal doc_id and different texts are different documents. No
    documents: no rows. Columns beyond those of documents are dropped.
    """
    keep = [c for c in DOC_COLUMNS if c in docs.columns]
    docs = docs.select(*keep)
    gone = covered(docs)
    d = docs.withColumn("th", F.xxhash64("text"))
    joined = d.join(gone, (d.doc_id == gone.doc_id) & (d.th == gone.th), "left").select(*[d[c] for c in keep], "gone")
    split = joined.withColumn("ls", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    new = F.when(F.col("ls").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("ls", i)), "\n"))
    out = split.withColumn("text", new).withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*keep, "n_removed")


ORACLE = """
with l as (select doc_id, string_split(text, chr(10)) ls from documents where doc_id is not null and text is not null),
w as (select doc_id, p - 1 as pos, [ls[p], ls[p + 1], ls[p + 2]] k from (select doc_id, ls, unnest(range(1, len(ls) - 1)) p from l)
      where not (trim(ls[p]) = '' and trim(ls[p + 1]) = '' and trim(ls[p + 2]) = '')),
r as (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) n from w),
g as (select distinct doc_id, pos + o as pos from r, (select unnest([0, 1, 2]) o) where n > 1),
s as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 as pos from l),
k as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where g.pos is null), '') as text, count(g.pos) n_removed
      from s left join g using (doc_id, pos) group by doc_id)
select d.doc_id, coalesce(k.text, d.text) as text, lang, source,
       case when coalesce(n_removed, 0) = 0 then n_chars else length(k.text) end as n_chars, cast(coalesce(n_removed, 0) as int) as n_removed
from documents d left join k using (doc_id)
"""
