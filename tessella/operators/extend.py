"""Places for a user's own stages, steps and features."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import DataFrame

from tessella.operators import preprocess
from tessella.operators.pipeline import useful_columns
from tessella.operators.preprocess import Stage
from tessella.operators.profile import numeric_columns


class Step(Protocol):
    """What a table goes through: any function from table to table, by ``DataFrame.transform``."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


_STAGES: dict[str, type[Stage]] = {c.__name__: c for c in vars(preprocess).values() if isinstance(c, type) and issubclass(c, Stage) and c is not Stage}
_GENERATORS: dict[str, Callable[..., DataFrame]] = {}


def register_stage(kind: type[Stage]) -> type[Stage]:
    """Makes a stage's saved form readable; the class's name is its kind, which must be free."""
    if _STAGES.get(kind.__name__, kind) is not kind:
        raise ValueError(f"{kind.__name__} is registered already")
    _STAGES[kind.__name__] = kind
    return kind


def stage_from_json(text: str) -> Stage:
    """A fitted stage from what ``Stage.to_json`` wrote."""
    x = json.loads(text)
    kind = _STAGES.get(x.pop("kind"))
    if kind is None:
        raise ValueError("no such stage is registered")
    return kind(**{f.name: x[f.name] for f in fields(kind) if f.name in x})


def chain_to_json(chain: preprocess.Chain) -> str:
    return json.dumps([json.loads(s.to_json()) for s in chain.stages])


def chain_from_json(text: str) -> preprocess.Chain:
    return preprocess.Chain(*[stage_from_json(json.dumps(s)) for s in json.loads(text)])


def through(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """The table after all steps; a step must keep the names that it doesn't change."""
    for step in steps:
        df = df.transform(step)
    return df


def register_generator(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _GENERATORS[name] = f
        return f

    return add


def generate(df: DataFrame, name: str, **settings) -> DataFrame:
    """The table with a registered generator's columns added; its own columns must stay as they are."""
    out = _GENERATORS[name](df, **settings)
    if out.columns[: len(df.columns)] != df.columns:
        raise ValueError(f"{name} changes the table's own columns")
    return out


@dataclass
class Selection:
    """A subset of columns and of rows of a binned table, and columns in the order of their worth."""

    columns: list[str]

    @staticmethod
    def by_index(df: DataFrame, indices: list[int]) -> Selection:
        return Selection([df.columns[i] for i in indices])

    @staticmethod
    def by_importance(importance: dict[str, float]) -> Selection:
        return Selection(sorted(importance, key=lambda c: (-importance[c], c)))

    def of(self, df: DataFrame, rows: DataFrame | None = None, key: str | None = None) -> DataFrame:
        """The columns in this order, of the rows whose key is in ``rows`` if that is given."""
        df = df if rows is None else df.join(rows.select(key).distinct(), key, "left_semi")
        return df.select(*self.columns)


def linear_columns(df: DataFrame, target: str) -> list[str]:
    """Numeric columns that a linear model may use: not the target, not constant, no ids."""
    useful = set(useful_columns(df, target))
    return [c for c in numeric_columns(df, (target,)) if c in useful]
