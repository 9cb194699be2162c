"""Readers: each returns a DataFrame of text columns as the file has them, or of documents (id, text, metadata)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DOCUMENT = "id string, text string, metadata map<string,string>"


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: names trimmed, empty ones _index, missing cells '', rows of blanks dropped; all strings."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape="\\", multiLine=True)
    names = [re.sub(r"^_c(\d+)$", r"_\1", c.strip()) for c in raw.columns]
    d = raw.toDF(*names).na.fill("")
    some = F.lit(False)
    for c in names:
        some = some | (F.trim(F.col(f"`{c}`")) != "")
    return d.where(some)


def json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that holds an array (or one object); Jackson streams it. A malformed file raises."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def numbered(rows: DataFrame, name: str = "nth") -> DataFrame:
    """rows with their position from 0. Rows are counted by partition, in an aggregate of a row a partition; nothing is sorted."""
    d = rows.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33))
    n = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, nth: the lines of each file that aren't empty, numbered from 0 in their file, however the files are split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_mid", F.monotonically_increasing_id())
    lines = lines.where("value <> ''").withColumn("_nth", F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_mid")))
    n = lines.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("_file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(n, ["_file", "_at"]).select("value", (F.col("_before") + F.col("_nth") - 1).alias("nth"))


def jsonl_documents(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id") -> DataFrame:
    """One JSON object a line; ids default to jsonl- and the line's number; the other fields become metadata; blank texts are dropped.

    Lines count from 0, without empty ones; a window holds one split of a file.
    """
    m = file_lines(spark, path).select("nth", F.from_json("value", "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, _: ~k.isin(text_field, id_field))
    d = m.select(F.coalesce(F.col("m")[id_field], F.concat(F.lit("jsonl-"), F.col("nth").cast("string"))).alias("id"), F.coalesce(F.col("m")[text_field], F.lit("")).alias("text"), rest.alias("metadata"))
    return d.where("trim(text) <> ''")


def directory_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """Every file below a folder with one of the extensions; id file: and the path's md5; blank files are dropped."""
    reader = spark.read.option("recursiveFileLookup", True)
    files = reader.text(path, wholetext=True).select("*", F.col("_metadata.file_path").alias("path"))
    d = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]) & (F.trim("value") != ""))
    return d.select(F.concat(F.lit("file:"), F.md5("path")).alias("id"), F.col("value").alias("text"), F.create_map(F.lit("path"), F.col("path")).alias("metadata"))


def sql_documents(spark: SparkSession, query: str, text_field: str = "text", id_field: str = "id", params: dict | None = None, metadata: list[str] | None = None) -> DataFrame:
    """The rows of a query (with bound parameters) as documents; metadata are the named columns, or all others."""
    d = spark.sql(query, args=params or {})
    return rows_as_documents(d, text_field, id_field, metadata)


def jdbc_documents(spark: SparkSession, url: str, query: str, text_field: str = "text", id_field: str = "id", metadata: list[str] | None = None, **options: str) -> DataFrame:
    d = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return rows_as_documents(d, text_field, id_field, metadata)


def rows_as_documents(d: DataFrame, text_field: str, id_field: str, metadata: list[str] | None = None) -> DataFrame:
    names = [c for c in d.columns if c not in (text_field, id_field)] if metadata is None else [c for c in metadata if c in d.columns]
    pairs = [x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return d.select(F.col(id_field).cast("string").alias("id"), F.col(text_field).cast("string").alias("text"), meta.alias("metadata")).where("trim(text) <> ''")


def text_documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"text-{i}", t, {}) for i, t in enumerate(texts)], DOCUMENT)


def flatten_json(text: Column) -> Column:
    """'path: value' lines of a JSON text."""
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def lines(x, at=""):
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from lines(v, f"{at}.{k}" if at else str(k))
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    yield from lines(v, f"{at}.{i}" if at else str(i))
            else:
                yield f"{at}: {'' if x is None else str(x).lower() if isinstance(x, bool) else x}"

        def one(t):
            try:
                return "\n".join(lines(json.loads(t)))
            except (ValueError, TypeError):
                return t

        return s.map(one)

    return run(text)


def source_file(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """One file as one document (doc_id, text): txt and md as they are, JSON as path: value lines, CSV as 'h: v, h: v' lines."""
    if allowed is not None and not any(path.startswith(a.rstrip("/") + "/") or path == a for a in allowed):
        raise PermissionError(f"{path} is outside the allowed paths")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        d = csv_table(spark, path)
        cells = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")) for c in d.columns])
        lines = d.select(F.monotonically_increasing_id().alias("i"), cells.alias("line"))
        text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    elif kind in ("txt", "md", "json"):
        text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
        if kind == "json":
            text = text.select(flatten_json(F.col("text")).alias("text"))
    else:
        raise ValueError(f"can't read .{kind} files")
    return text.select(F.lit(path).alias("doc_id"), "text", F.lit(path).alias("source"))


def sentiment_samples(d: DataFrame) -> DataFrame:
    """id, text, label with defaults: the row's position and 'negative'."""
    has = lambda c: F.col(c) if c in d.columns else F.lit(None)
    d = numbered(d, "_loom_nth")
    return d.select(F.coalesce(has("id").cast("long"), F.col("_loom_nth")).alias("id"), F.coalesce(has("text"), F.lit("")).alias("text"), F.coalesce(has("label"), F.lit("negative")).alias("label"))


def dictionary(d: DataFrame, word: str, translations: list[str]) -> DataFrame:
    """word (lower case), translations: merged and distinct, in order."""
    all_of = F.filter(F.array(*[F.trim(c) for c in translations]), lambda t: t.isNotNull() & (t != ""))
    rows = d.select(F.lower(F.trim(word)).alias("word"), F.posexplode(all_of).alias("p", "t")).where("word <> ''")
    g = rows.groupBy("word", "t").agg(F.min("p").alias("p"))
    return g.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("translations"))


def definitions(d: DataFrame, word: str = "word", definition: str = "definition") -> DataFrame:
    """word (lower case), definition: of several the last in the order of rows."""
    rows = numbered(d, "_loom_nth").select(F.lower(F.trim(word)).alias("word"), F.trim(definition).alias("definition"), "_loom_nth")
    return rows.where("word <> '' and definition <> ''").groupBy("word").agg(F.max_by("definition", "_loom_nth").alias("definition"))


def word_map(d: DataFrame) -> DataFrame:
    return d.where(~F.contains("word", F.lit(" ")))


def phrase_map(d: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    return d.where(F.size(F.split("word", r"\s+")).between(low, high))


def integrity(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name, exists, size, sha1 of the named files in a folder."""
    want = spark.createDataFrame([(n,) for n in names], "name string")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha1("content").alias("sha1"))
    return want.join(files, "name", "left").select("name", F.col("sha1").isNotNull().alias("exists"), "size", "sha1")


def geo_tables(spark: SparkSession, countries_with_states: str, countries: str, cities: str):
    """The tables of ``operators.geo`` from three JSON arrays: countries with their states, countries with latlng, cities (numbers may be text)."""
    from ..operators.geo import Geo

    c = json_table(spark, countries_with_states, "name string, iso2 string, iso3 string, phone_code string, states array<struct<name:string,state_code:string>>")
    places = json_table(spark, countries, "cca2 string, name struct<common:string>, latlng array<double>")
    town = json_table(spark, cities, "name string, country_code string, state_code string, latitude string, longitude string")
    text = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    number = lambda x, n: F.coalesce(F.expr(f"try_cast({x} as double)"), F.lit(0.0)).alias(n)
    return Geo(
        c.select(text("name"), text("iso2"), text("iso3"), text("phone_code")),
        c.select(F.col("iso2"), F.explode("states").alias("s")).select("s.name", F.coalesce("s.state_code", F.lit("")).alias("state_code"), "iso2"),
        places.where("size(latlng) >= 2").select("cca2", F.col("name.common").alias("name"), F.col("latlng")[0].alias("lat"), F.col("latlng")[1].alias("lon")),
        town.select(F.monotonically_increasing_id().alias("city_id"), text("name"), text("country_code"), text("state_code"), number("latitude", "lat"), number("longitude", "lon")),
    )
