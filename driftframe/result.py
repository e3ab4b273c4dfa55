"""The result as plain objects, read from the two small frames of counts and examples."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Example:
    key: list[Any]  # levels, innermost first
    left: Any = None
    right: Any = None


@dataclass
class Counted:
    count: int = 0
    examples: list[Example] = field(default_factory=list)


@dataclass
class FieldDiffs:
    """``kind``: common (identical, different, left_only, right_only), left (nulls, left_only), right (nulls, right_only)."""

    kind: str
    categories: dict[str, Counted] = field(default_factory=dict)

    def counts(self) -> tuple[int, ...]:
        return tuple(c.count for c in self.categories.values())


@dataclass
class Scope:
    """The root, or a keyed array. One-sided arrays have only ``records`` and the names of their fields."""

    records: dict[str, Counted] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    fields: dict[str, FieldDiffs] = field(default_factory=dict)


@dataclass
class DatasetDiffs:
    root: Scope
    keyed_arrays: dict[str, Scope]
    left_schema: T.StructType
    right_schema: T.StructType


def read(counts: DataFrame, examples: DataFrame | None, left: T.StructType, right: T.StructType) -> DatasetDiffs:
    """Both frames are small: counts have a few rows a field, examples at most ``max_examples`` a count."""
    scopes: dict[str, Scope] = {"": Scope()}
    for r in counts.collect():
        scope = scopes.setdefault(r["scope"], Scope())
        if r["field"] == "" and r["kind"] == "kind":
            scope.kinds[r["category"]] = r["n"]
        elif r["field"] == "":
            scope.records[r["category"]] = Counted(r["n"])
        else:
            scope.fields.setdefault(r["field"], FieldDiffs(r["kind"])).categories[r["category"]] = Counted(r["n"])
    for r in examples.collect() if examples is not None else ():
        scope = scopes[r["scope"]]
        own = scope.records if r["field"] == "" else scope.fields[r["field"]].categories
        value = lambda said: None if said is None else json.loads(said)["v"]
        own[r["category"]].examples.append(Example(json.loads(r["key"]), value(r["left"]), value(r["right"])))
    return DatasetDiffs(scopes.pop(""), scopes, left, right)
