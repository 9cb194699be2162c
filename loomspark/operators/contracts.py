"""What own parts must offer to take the place of those given here. Protocols: a class that has the methods conforms."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

Post = Callable[[str, dict[str, str], dict[str, Any]], dict[str, Any]]  # url, headers, body -> the answer's JSON


# estimators: fit returns the estimator, fitted; everything else is a projection of its input


@runtime_checkable
class Estimator(Protocol):
    def fit(self, df: DataFrame) -> Any: ...


@runtime_checkable
class Predictor(Estimator, Protocol):
    """A classifier or regressor: ``prediction`` for each row."""

    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Transformer(Estimator, Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class OnlineLearner(Predictor, Protocol):
    """One that can be given more rows after it was fitted."""

    def partial_fit(self, df: DataFrame) -> Any: ...


@runtime_checkable
class Parametric(Protocol):
    def get_params(self) -> dict[str, Any]: ...

    def with_params(self, **params: Any) -> Any: ...


@runtime_checkable
class RandomStateAware(Protocol):
    """One whose choices follow from a seed."""

    seed: int


@runtime_checkable
class Persistable(Protocol):
    def to_dict(self) -> dict[str, Any]: ...

    def save(self, path: str) -> None: ...


# language


@runtime_checkable
class Tokenizer(Protocol):
    def __call__(self, text: Column | str) -> Column:
        """An array of tokens."""


@runtime_checkable
class Vectorizer(Protocol):
    def fit(self, df: DataFrame, key: str) -> Any: ...

    def transform(self, df: DataFrame, key: str) -> DataFrame: ...


@runtime_checkable
class PosTagger(Protocol):
    def tags_of(self, tokens: Column) -> Column: ...


@runtime_checkable
class TrainablePosTagger(PosTagger, Protocol):
    def fit(self, sentences: list[list[tuple[str, str]]]) -> Any: ...


@runtime_checkable
class EntityTagger(Protocol):
    def extract(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, entity, label, start, end, confidence."""


@runtime_checkable
class TrainableEntityTagger(EntityTagger, Protocol):
    def fit(self, sentences: list[list[tuple[str, str]]]) -> Any: ...


@runtime_checkable
class TextTranslator(Protocol):
    def translate(self, text: Column) -> Column: ...


@runtime_checkable
class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


# retrieval


@runtime_checkable
class DocumentLoader(Protocol):
    def __call__(self, *args: Any, **kwargs: Any) -> DataFrame:
        """id, text, metadata."""


@runtime_checkable
class TextSplitter(Protocol):
    def __call__(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame: ...


@runtime_checkable
class VectorStore(Protocol):
    def upsert(self, new: DataFrame) -> Any: ...

    def search(self, query: list[float], k: int = 5, filters: dict | None = None) -> DataFrame: ...


@runtime_checkable
class PersistableVectorStore(VectorStore, Protocol):
    def export_items(self) -> DataFrame: ...

    def import_items(self, items: DataFrame) -> Any: ...


@runtime_checkable
class Retriever(Protocol):
    def contexts(self, question: str, k: int = 5, filters: dict | None = None) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    def __call__(self, hits: DataFrame, query: str) -> DataFrame: ...


@runtime_checkable
class QueryExpander(Protocol):
    def __call__(self, query: str) -> list[str]: ...


@runtime_checkable
class AnswerVerifier(Protocol):
    def __call__(self, answer: str, scores: list[float]) -> list[str]:
        """What is wrong with the answer; nothing, if it holds."""


@runtime_checkable
class LanguageModel(Protocol):
    def generate(self, prompt: str, **options: Any) -> str: ...


@runtime_checkable
class StreamingLanguageModel(LanguageModel, Protocol):
    def stream(self, prompt: str, **options: Any) -> Iterable[str]: ...


@runtime_checkable
class RoutingModel(Protocol):
    def __call__(self, messages: list[dict], tools: dict) -> dict:
        """{type: tool_call, tool, input} or {type: final, content}."""


@runtime_checkable
class ToolContract(Protocol):
    name: str
    description: str

    def call(self, given: dict) -> str: ...
