"""License scan: exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written


@dataclass(frozen=True)
class Notice:
    """The wording of a notice, the words that name it, which a match must hold, and those of other notices, which it may not."""

    text: str
    names: str = ""
    others: str = ""


TEMPLATES = {
    "Apache-2.0": Notice("Licensed under the Apache License, Version 2.0.", "apache"),
    "Apache-2.0-notice": Notice(
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "apache",
    ),
    "BSD-3-Clause": Notice("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution binary"),
    "CC-BY-4.0": Notice("Licensed under CC BY 4.0.", "cc by", "nc sa nd"),
    "CC-BY-NC-4.0": Notice("Licensed under CC BY-NC 4.0.", "cc by nc", "sa nd"),
    "CC-BY-SA-4.0": Notice("Licensed under CC BY-SA 4.0.", "cc by sa", "nc nd"),
    "GPL-2.0": Notice(
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation.",
        "gnu general 2",
        "lesser affero",
    ),
    "GPL-3.0": Notice("This work is licensed under the GNU General Public License, version 3.", "gnu general 3", "lesser affero"),
    "GPL-3.0-notice": Notice(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu general 3",
        "lesser affero",
    ),
    "MIT": Notice("Released under the MIT License.", "mit"),
    "MIT-grant": Notice("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "permission granted"),
    "MPL-2.0": Notice("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
}
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8


def words_of(text: str) -> frozenset[str]:
    return frozenset(w for w in re.split(BREAK, text.lower()) if w)


@dataclass(frozen=True)
class Template:
    words: frozenset[str]
    names: frozenset[str]
    others: frozenset[str]
    need: int

    def meets(self, have) -> bool:
        """Whether a block with these words does, but for the words of others."""
        return len(self.words & have) >= self.need and self.names <= have


def template_sets(templates: dict[str, Notice | str], threshold: float) -> dict[str, Template]:
    """A template for each notice that has words; of n words it needs ceil(threshold n)."""
    out = {}
    for k, v in templates.items():
        notice = Notice(v) if isinstance(v, str) else v
        if words := words_of(notice.text):
            out[k] = Template(words, words_of(notice.names), words_of(notice.others), math.ceil(threshold * len(words) - 1e-9))
    return out


def paragraphs(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, first (line, from 0), lw (the vocabulary's words in each line), ts (those of all lines): a row for each paragraph with any.

    A paragraph is a longest run of lines that have words, of the vocabulary or not.
    """
    line = lambda s: F.array_remove(F.split(F.lower(s), BREAK, -1), "")
    known = F.array(*map(F.lit, vocabulary))
    lines = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.transform(F.split("text", "\n", -1), lambda s: F.transform(F.array(line(s)), lambda w: F.when(F.size(w) > 0, F.array_intersect(w, known)))[0]).alias("lw"),
    )
    blank = F.filter(F.transform("lw", lambda w, i: F.when(w.isNull(), i)), lambda i: i.isNotNull())
    lines = lines.select("doc_id", "lw", F.concat(F.array(F.lit(-1)), blank, F.array(F.size("lw"))).alias("b"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("b") - 2),
        lambda j: F.struct((F.get("b", j) + 1).alias("first"), F.slice("lw", F.get("b", j) + 2, F.get("b", j + 1) - F.get("b", j) - 1).alias("lw")),
    )
    each = lines.select("doc_id", F.explode(runs).alias("p")).select("doc_id", "p.first", "p.lw")
    return each.withColumn("ts", F.array_distinct(F.flatten("lw"))).where(F.size("ts") > 0)


def windows(lines: list[list[str]], template: Template) -> Iterator[tuple[int, int, int]]:
    """first, last, overlap of the least runs of lines that meet the template together; no such run holds another.

    lines: the known words of each line. Runs with words of others are left out at the end: a longer run can't lose them.
    """
    sought = template.words | template.names
    here, held, first, before = [sought.intersection(w) for w in lines], Counter(), 0, -1
    for last, words in enumerate(here):
        held.update(words)
        while first <= last and template.meets(held.keys() - {w for w in here[first] if held[w] == 1}):
            for w in here[first]:
                held[w] -= 1
                if not held[w]:
                    del held[w]
            first += 1
        if first > before and template.meets(held.keys()):
            before = first
            if not any(template.others.intersection(w) for w in lines[first : last + 1]):
                yield first, last, len(template.words & held.keys())


def scan(docs: DataFrame, templates: dict[str, Notice | str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_line, last_line, license, overlap, containment for every least block that meets a template.

    A block is any run of consecutive lines of a paragraph (lines from 0; a line without words ends a paragraph), so a notice may be
    wrapped, or marked as a comment. It meets a template if it holds at least ``threshold`` of its word set and all the words that
    name it; of such blocks those that hold no other are reported, unless they have a word that tells another notice ("nc" in CC BY).
    Words are lower-case runs of ASCII letters and digits and of non-ASCII characters; overlap counts the template's.

    Paragraphs are joined with templates: words are ordered by the number of paragraphs of the corpus that have them, rarest first
    (words of no template can't match and are left out). A template with n words needs a = ceil(threshold n) common ones. Candidates
    are pairs that share a word among the first n - a + 1 of the template and the first m - a + 1 of the paragraph's m (prefix
    filter), with m >= a (length filter) and enough words left behind the shared one on both sides (positional filter); all
    candidates are counted exactly, then cut to their least blocks. The template index is as large as the templates, whatever the
    data, so it is broadcast.

    Null text: no row. A null doc_id is carried. Repeated rows give one result. A text of any length is scanned whole; a row of
    the join has the known words of a paragraph. Empty text or no documents: no rows. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = template_sets(TEMPLATES if templates is None else templates, threshold)
    if sum(len(t.words) for t in sets.values()) > 100_000:
        raise ValueError("the templates are too large to be broadcast")
    spark, schema = docs.sparkSession, "doc_id long, first_line int, last_line int, license string, overlap int, containment double"
    if not sets:
        return spark.createDataFrame([], schema)
    vocabulary = sorted(frozenset().union(*(t.words for t in sets.values())))
    told = sorted(frozenset().union(*(t.names | t.others for t in sets.values())).difference(vocabulary))
    found = written(paragraphs(docs, vocabulary + told))
    count = dict.fromkeys(vocabulary, 0) | {w: n for w, n in found.select(F.explode("ts").alias("w")).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    index = []
    for name, t in sets.items():
        ranks = sorted(rank[w] for w in t.words)
        index += [(r, j, name, len(ranks), t.need, ranks) for j, r in enumerate(ranks[: len(ranks) - t.need + 1])]
    prefixes = spark.createDataFrame(index, "r int, j int, license string, n int, need int, tr array<int>")
    ranks_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    least = min(x[4] for x in index)
    ranked = found.withColumn("br", F.array_sort(F.array_compact(F.transform("ts", lambda w: F.try_element_at(ranks_of, w))))).withColumn("m", F.size("br")).where(F.col("m") >= least)
    first = ranked.select("doc_id", "first", "lw", "m", "br", F.posexplode(F.slice("br", 1, F.col("m") - least + 1)).alias("i", "r"))
    near = first.join(F.broadcast(prefixes), "r").where((F.col("m") >= F.col("need")) & (F.col("i") <= F.col("m") - F.col("need")) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= F.col("need")))
    candidates = near.where(F.size(F.array_intersect("br", "tr")) >= F.col("need")).select("doc_id", "first", "lw", "license")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc_id, first + a, first + b, name, n, round(n / len(sets[name].words), 6))
                for doc_id, first, lines, name in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "lw", "license")))
                for a, b, n in windows(lines, sets[name])
            ]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "first_line", "last_line", "license", "overlap", "containment"])

    return map_batches(candidates, run, schema).distinct()  # a pair that meets in several prefix words is several candidates


def _oracle() -> str:
    sets = template_sets(TEMPLATES, THRESHOLD)
    array = lambda words: "[" + ", ".join(repr(w) for w in sorted(words)) + "]::varchar[]"
    rows = ", ".join(f"('{k}', {array(t.words)}, {array(t.names)}, {array(t.others)}, {t.need})" for k, t in sets.items())
    return rf"""
with t(license, tw, names, others, need) as (values {rows}),
l as (select doc_id, pos - 1 as line, list_distinct(regexp_extract_all(lower(s), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) ws
      from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null)),
p as (select *, sum(case when len(ws) = 0 then 1 else 0 end) over (partition by doc_id order by line) as par from l),
w as (select doc_id, par, line, license, names, others, need, len(tw) as n, list_intersect(ws, tw) as tws, list_intersect(ws, names) as nws, len(list_intersect(ws, others)) as bad
      from p, t where len(ws) > 0),
c as (select doc_id, par, license from w group by doc_id, par, license
      having len(list_distinct(flatten(list(tws)))) >= any_value(need) and len(list_distinct(flatten(list(nws)))) >= len(any_value(names))),
k as (select w.* from w join c using (doc_id, par, license)),
r as (select a.doc_id, a.par, a.license, a.line as f, b.line as e, any_value(a.n) as n, len(list_distinct(flatten(list(m.tws)))) as overlap, sum(m.bad) as bad
      from k a join k b on a.doc_id = b.doc_id and a.par = b.par and a.license = b.license and b.line >= a.line and len(a.tws) + len(a.nws) > 0 and len(b.tws) + len(b.nws) > 0
      join k m on a.doc_id = m.doc_id and a.par = m.par and a.license = m.license and m.line between a.line and b.line
      group by a.doc_id, a.par, a.license, a.line, b.line
      having overlap >= any_value(a.need) and len(list_distinct(flatten(list(m.nws)))) >= len(any_value(a.names)))
select doc_id, cast(f as int) as first_line, cast(e as int) as last_line, license, cast(overlap as int) as overlap, round(overlap / n, 6) as containment
from r where bad = 0 and not exists (select 1 from r s where s.doc_id = r.doc_id and s.par = r.par and s.license = r.license and s.f >= r.f and s.e <= r.e and (s.f, s.e) <> (r.f, r.e))
"""


ORACLE = _oracle()
