"""Text functions in a chain: ``Text("text").strip_accents().lower().slug().column``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Text:
    """A string column; methods that give text give another Text, the others a column."""

    source: Column | str

    @property
    def column(self) -> Column:
        return F.col(self.source) if isinstance(self.source, str) else self.source

    def _then(self, f, *args) -> Text:
        return Text(f(self.column, *args))

    def lower(self) -> Text:
        return self._then(F.lower)

    def upper(self) -> Text:
        return self._then(F.upper)

    def title(self) -> Text:
        return self._then(T.title)

    def normalize_unicode(self, form: str = "NFC") -> Text:
        return self._then(T.normalize_unicode, form)

    def strip_accents(self) -> Text:
        return self._then(T.strip_accents)

    def remove_emoji(self) -> Text:
        return self._then(T.remove_emoji)

    def keep_emoji(self) -> Text:
        return self._then(T.keep_emoji)

    def remove_punctuation(self) -> Text:
        return self._then(T.remove_punctuation)

    def keep_punctuation(self) -> Text:
        return self._then(T.keep_punctuation)

    def collapse(self) -> Text:
        return self._then(T.collapse)

    def slug(self) -> Text:
        return self._then(T.slug)

    def mask_pii(self) -> Text:
        return self._then(T.redact_pii)

    def sentences(self) -> Column:
        return T.sentences(self.column)

    def words(self) -> Column:
        return T.words(self.column)

    def ngrams(self, n: int = 2) -> Column:
        return T.ngrams(self.column, n)

    def initials(self, most: int = 6) -> Column:
        return T.initials(self.column, most)

    def language(self) -> Column:
        from ..operators.nlp import detect_language

        return detect_language(self.column)["language"]

    def language_with_score(self) -> Column:
        from ..operators.nlp import detect_language

        return detect_language(self.column)

    def keywords(self, top: int = 10) -> Column:
        from ..operators.nlp import keywords

        return keywords(self.column, top)

    def entities(self, tagger=None) -> Column:
        from ..operators.nlp import entities

        return entities(self.column, tagger)

    def semantics(self, df: DataFrame, explorer) -> DataFrame:
        """word, definition, synonyms for each distinct word that the column holds in df, by a ``SemanticExplorer``'s tables."""
        from ..operators.nlp import word_semantics

        return word_semantics(df.select(self.column.alias("word")), explorer.definitions, explorer.words, explorer.synsets)

    def pos_tags(self, language: str = "en") -> Column:
        from ..operators.nlp import pos_tags

        return pos_tags(self.column, language)
