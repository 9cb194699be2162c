"""Named datasets: what there is, whether it is whole, under which terms, and indexes over places."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import Geo, suggest
from ..operators.nlp import NerTagger
from . import readers

DATASETS = (
    ("wordnet", "1.0", "en", "wordnet-json", "wordnet/wn.json"),
    ("sentiment", "1.0", "en", "sentiment-json", "sentiment/sentiment_dataset.json"),
    ("geo-countries", "1.0", "multi", "countries-json", "geo/countries.json"),
    ("geo-countries-states", "1.0", "multi", "countries-states-json", "geo/countries+states.json"),
    ("geo-cities", "1.0", "multi", "cities-json", "geo/cities.json"),
    ("dictionary-en", "1.0", "en", "word-definition-csv", "dictionary/en/en.csv"),
    ("dictionary-en-bemba", "1.0", "en,bem", "translation-csv", "dictionary/bemba/english_to_bemba.csv"),
)
# name, where it is from, terms, use, whom to name
TERMS = (
    ("wordnet", "WordNet as JSON", "WordNet License", "synonyms and definitions", "Princeton University"),
    ("sentiment", "labelled sentences", "ask before passing on", "training and evaluation", "its contributors"),
    ("geo", "countries, states and cities as JSON", "by source; ask before commercial use", "gazetteers and nearest places", "its providers"),
    ("dictionary_en", "English definitions as CSV", "by source", "definitions and words by meaning", "its maintainers"),
    ("dictionary_bemba", "English to Bemba as CSV", "by source", "translation", "its contributors"),
)


@dataclass
class DatasetRegistry:
    """Datasets below a folder that the user fills; nothing comes with this package."""

    spark: SparkSession
    base: str
    entries: tuple[tuple[str, str, str, str, str], ...] = DATASETS
    terms: tuple[tuple[str, str, str, str, str], ...] = TERMS

    def list_datasets(self) -> DataFrame:
        rows = [(n, v, lang, schema, f"{self.base.rstrip('/')}/{p}") for n, v, lang, schema, p in self.entries]
        return self.spark.createDataFrame(rows, "name string, version string, language string, schema string, path string")

    def integrity_report(self) -> DataFrame:
        """name, exists, size, sha1 of each dataset's file; '' and 0 where it isn't there. A file is a row: at most 2 GB."""
        d = self.list_datasets()
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        files = reader.load(self.base).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.sha1("content").alias("sha1"))
        j = d.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(files, "path", "left")
        return j.select("name", F.col("sha1").isNotNull().alias("exists"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("sha1", F.lit("")).alias("sha1"))

    def licenses(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.terms), "name string, source string, license string, usage string, attribution string")

    def geo(self) -> Geo:
        at = {e[0]: f"{self.base.rstrip('/')}/{e[4]}" for e in self.entries}
        return readers.geo_tables(self.spark, at["geo-countries-states"], at["geo-countries"], at["geo-cities"])


@dataclass
class DatasetCache:
    """Tables by key, as Parquet below a shared folder; a table that was made once is read from there."""

    spark: SparkSession
    folder: str
    known: dict[str, DataFrame] = field(default_factory=dict)

    def path(self, key: str) -> str:
        return f"{self.folder.rstrip('/')}/{hashlib.sha1(key.encode()).hexdigest()}"

    def has(self, key: str) -> bool:
        if key in self.known:
            return True
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def get(self, key: str) -> DataFrame | None:
        if key not in self.known and self.has(key):
            self.known[key] = self.spark.read.parquet(self.path(key))
        return self.known.get(key)

    def set(self, key: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(self.path(key))
        self.known[key] = self.spark.read.parquet(self.path(key))
        return self.known[key]


@dataclass
class DatasetIndex:
    """Lookups over places; the gazetteer is cached where there is a cache."""

    geo: Geo
    cache: DatasetCache | None = None

    def gazetteer(self, max_cities: int | None = 10_000) -> DataFrame:
        key = f"gazetteer-{max_cities}"
        if self.cache is None:
            return self.geo.gazetteer(max_cities)
        return self.cache.get(key) if self.cache.has(key) else self.cache.set(key, self.geo.gazetteer(max_cities))

    def tagger(self, max_cities: int = 10_000) -> NerTagger:
        """An automaton of the names finds them in texts."""
        return NerTagger({r.name: r.label for r in self.gazetteer(max_cities).toLocalIterator()})

    def suggest(self, prefix: str, limit: int = 20) -> DataFrame:
        return suggest(self.gazetteer(), prefix, limit)

    def contains(self, name: str) -> bool:
        return not self.gazetteer().where(F.col("name") == name.strip().lower()).isEmpty()

    def nearest(self, points: DataFrame, key: str, k: int = 5) -> DataFrame:
        return self.geo.nearest_cities(points, key, k)
