"""What estimators and transformers share: parameters, errors, saving and loading."""

from __future__ import annotations

import dataclasses
import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvalidArgument(ValueError):
    pass


class NotTrained(RuntimeError):
    pass


class SerializationError(RuntimeError):
    pass


REGISTRY: dict[str, type] = {}


@dataclass
class Parametric:
    """Hyper-parameters are the dataclass's fields; ``state`` holds what fitting found (JSON values)."""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        REGISTRY[cls.__name__] = cls

    def get_params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_params(self, **params):
        """A fresh, untrained copy with some parameters changed."""
        unknown = params.keys() - {f.name for f in fields(self)}
        if unknown:
            raise InvalidArgument(f"unknown parameters: {sorted(unknown)}")
        return dataclasses.replace(self, **params)

    @property
    def state(self) -> dict:
        found = self.__dict__.get("_state")
        if found is None:
            raise NotTrained(type(self).__name__)
        return found

    def _trained(self, **state):
        self.__dict__["_state"] = state
        return self

    def to_dict(self) -> dict:
        params = {k: v.to_dict() if isinstance(v, Parametric) else [x.to_dict() if isinstance(x, Parametric) else x for x in v] if isinstance(v, (list, tuple)) else v for k, v in self.get_params().items()}
        return {"class": type(self).__name__, "params": params, "state": self.__dict__.get("_state")}

    @staticmethod
    def from_dict(d: dict):
        try:
            cls = REGISTRY[d["class"]]
            make = lambda v: Parametric.from_dict(v) if isinstance(v, dict) and "class" in v else [make(x) for x in v] if isinstance(v, list) else v
            out = cls(**{k: make(v) for k, v in d["params"].items()})
        except (KeyError, TypeError) as e:
            raise SerializationError(f"not a saved model: {e}") from e
        if d.get("state") is not None:
            out._trained(**d["state"])
        return out

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.to_dict(), f)

    @classmethod
    def load(cls, path: str):
        try:
            with open(path) as f:
                model = Parametric.from_dict(json.load(f))
        except json.JSONDecodeError as e:
            raise SerializationError(str(e)) from e
        if not isinstance(model, cls):
            raise SerializationError(f"{path} holds a {type(model).__name__}")
        return model


class Transformer(Parametric, ABC):
    """fit reads a table once; transform is a projection of ``features``."""

    @abstractmethod
    def fit(self, df: DataFrame): ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Classifier(Parametric, ABC):
    """fit(df with features and label); predict adds ``prediction``."""

    @abstractmethod
    def fit(self, df: DataFrame): ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...

    def predict_swapped(self, df: DataFrame, swaps: str) -> DataFrame:
        """A row for each of ``swaps`` (an array of structs with j and v), as ``swap``; predicted as if feature j were v."""
        rows = df.withColumn("swap", F.explode(swaps)).drop(swaps)
        return self.predict(rows.withColumn("features", F.transform("features", lambda x, i: F.when(i == F.col("swap.j"), F.col("swap.v")).otherwise(x))))


class ProbabilisticClassifier(Classifier):
    """predict also adds ``score``, the probability of the positive class."""


class Regressor(Parametric, ABC):
    """fit(df with features and target); predict adds ``prediction``."""

    @abstractmethod
    def fit(self, df: DataFrame): ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...


class Clusterer(Parametric, ABC):
    """fit(df with features); predict adds ``cluster``."""

    @abstractmethod
    def fit(self, df: DataFrame): ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...


def check_matrix(df: DataFrame, column: str = "features") -> int:
    """The common length of the arrays; raises if there is none. Costs a job, so only fitting calls it."""
    low, high, nulls = df.agg(F.min(F.size(column)), F.max(F.size(column)), F.count_if(F.col(column).isNull())).first()
    if low is None or nulls or low != high or low < 1:
        raise InvalidArgument("features must be non-empty arrays of one length, and rows there must be")
    return low
