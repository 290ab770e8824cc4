"""Typed, range-checked parameters of operators, also read from JSON files.

A class has a field for each argument of its operator, so ``operator(rows, **params.values())``
runs it.  A value of another type or out of its range is refused when the
object is made, before any job starts.
"""

from __future__ import annotations

import math
from dataclasses import Field, asdict, dataclass, field, fields
from typing import Any, Self, get_type_hints

from pyspark.sql import SparkSession

_SQL_TYPES = {int: "long", float: "double", bool: "boolean", str: "string"}


def bounded(default: Any, low: float | None = None, high: float | None = None, above: float | None = None, one_of: tuple | None = None) -> Any:
    """A field with limits: at least ``low``, at most ``high``, more than ``above``, or one of a few values."""
    return field(default=default, metadata={"low": low, "high": high, "above": above, "one_of": one_of})


def _fault(f: Field, kind: type, value: Any) -> str | None:
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind:
        return f"must be of type {kind.__name__}"
    if kind is float and not math.isfinite(value):
        return "must be finite"
    limits = f.metadata
    for name, broken in (("low", lambda v, x: v < x), ("high", lambda v, x: v > x), ("above", lambda v, x: v <= x), ("one_of", lambda v, x: v not in x)):
        if limits.get(name) is not None and broken(value, limits[name]):
            return {"low": "must be at least", "high": "must be at most", "above": "must be more than", "one_of": "must be one of"}[name] + f" {limits[name]}"
    return None


@dataclass(frozen=True)
class Parameters:
    """Base: checks every field's type and range, then what holds between fields."""

    def __post_init__(self) -> None:
        hints = get_type_hints(type(self))
        faults = [f"{f.name} {fault}" for f in fields(self) if (fault := _fault(f, hints[f.name], getattr(self, f.name)))]
        if not faults and (between := self.between()):
            faults = [between]
        if faults:
            raise ValueError(f"{type(self).__name__}: " + "; ".join(faults))

    def between(self) -> str | None:
        """What is wrong between fields, if anything."""

    def values(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Self:
        """From a JSON object in a file; missing fields keep their defaults, unknown ones and broken files are refused."""
        found = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        hints = get_type_hints(cls)
        known = {f.name: hints[f.name] for f in fields(cls)}
        unknown = sorted(set(found.columns) - set(known))
        rows = found.limit(2).collect()
        if unknown or len(rows) != 1:
            raise ValueError(f"{cls.__name__}: " + (f"unknown fields {unknown}" if unknown else "one object is expected"))
        return cls(**{name: float(value) if known[name] is float and type(value) is int else value for name, value in rows[0].asDict().items() if value is not None})

    @classmethod
    def schema(cls) -> str:
        """The fields as a DDL string, for tables that hold one set of parameters a row."""
        hints = get_type_hints(cls)
        return ", ".join(f"{f.name} {_SQL_TYPES[hints[f.name]]}" for f in fields(cls))


@dataclass(frozen=True)
class Merging(Parameters):
    """Of ``folds.merge_intervals``."""

    min_iou: float = bounded(0.3, 0.0, 1.0)
    max_gap: float = bounded(5.0, 0.0)
    min_similarity: float = bounded(0.5, 0.0, 1.0)


@dataclass(frozen=True)
class Segmenting(Parameters):
    """Of ``detection.segment_plan``."""

    window: float = bounded(60.0, above=0.0)
    overlap: float = bounded(0.0, 0.0)

    def between(self) -> str | None:
        return None if self.overlap < self.window else "overlap must be less than window"


@dataclass(frozen=True)
class Spiking(Parameters):
    """Of ``series.robust_spikes``."""

    factor: float = bounded(6.0, above=0.0)
    least: int = bounded(6, 1)


@dataclass(frozen=True)
class Suppressing(Parameters):
    """Of ``series.suppress_near``."""

    gap: float = bounded(1.0, 0.0)
    most: int = bounded(6, 1)


@dataclass(frozen=True)
class Voting(Parameters):
    """Of ``series.vote``."""

    of: int = bounded(6, 1)
    needs: int = bounded(3, 1)

    def between(self) -> str | None:
        return None if self.needs <= self.of else "needs must be at most of"


@dataclass(frozen=True)
class Accepting(Parameters):
    """Of ``retrieval.accept``."""

    k: int = bounded(5, 1)
    least: float = bounded(0.1, 0.0, 1.0)


@dataclass(frozen=True)
class Batching(Parameters):
    """Of ``folds.greedy_batches``."""

    budget: int = bounded(1_000, 1)
