"""Entry points."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftframe.config import ConfigError, DiffConfig
from driftframe.durable import cut
from driftframe.functions.status import IDENTICAL, Level, OneSidedScope, lay_out
from driftframe.operators.counts import counts
from driftframe.operators.examples import SCHEMA, examples
from driftframe.operators.match import judged, matched
from driftframe.plans.plan import LEFT, RIGHT, Plan, build_plan, same_type
from driftframe.result import DatasetDiffs, read

Config = DiffConfig | Mapping[str, Any]


def as_config(config: Config) -> DiffConfig:
    return config if isinstance(config, DiffConfig) else DiffConfig.from_dict(config)


@dataclass
class Diff:
    """A comparison. Counts are lazy; nothing is read before they are used."""

    left: DataFrame
    right: DataFrame
    plan: Plan

    @cached_property
    def levels(self) -> tuple[Level, list[OneSidedScope]]:
        return lay_out(self.plan)

    def judged(self, values: bool = False) -> DataFrame:
        return judged(matched(self.left, self.right, self.plan), self.levels[0], values)

    def counts(self) -> DataFrame:
        """``(scope, field, kind, category, n)``."""
        return counts(self.judged(), *self.levels)

    def examples(self, judged_values: DataFrame | None = None) -> DataFrame:
        """``(scope, field, category, key, left, right)``, at most ``max_examples`` of each kind. The records that differ are
        written to the shared folder when this is called; every kind of example is read from there."""
        if not self.plan.config.max_examples:
            return self.left.sparkSession.createDataFrame([], SCHEMA)
        rows = self.judged(values=True) if judged_values is None else judged_values
        return examples(cut(rows.filter(F.col("c") != IDENTICAL)), *self.levels, self.plan, self.left, self.right)

    def run(self) -> DatasetDiffs:
        """The whole result on the driver. Counts come from statuses alone; of the records only those that differ are written, to
        the shared folder, for the examples."""
        shown = self.examples() if self.plan.config.max_examples else None
        return read(self.counts(), shown, self.plan.reported_schema(LEFT), self.plan.reported_schema(RIGHT))


def diff(left: DataFrame, right: DataFrame, config: Config) -> Diff:
    """Compare two frames."""
    return Diff(left, right, build_plan(left.schema, right.schema, as_config(config)))


def diff_pruned(left: Callable[[T.StructType], DataFrame], right: Callable[[T.StructType], DataFrame], left_schema: T.StructType, right_schema: T.StructType, config: Config) -> Diff:
    """Compare two sources that are read with the schema they are given: only what is compared, nested fields included."""
    config = as_config(config)
    first = build_plan(left_schema, right_schema, config)
    frames = []
    for side, read in ((LEFT, left), (RIGHT, right)):
        wanted = first.read_schema(side)
        frame = read(wanted)
        check_read(frame.schema, wanted, side)
        frames.append(frame)
    return diff(*frames, config)


def check_read(got: T.StructType, wanted: T.StructType, side: str) -> None:
    """The frame read has the columns asked for, in any order, with their types."""
    names, asked = {f.name: f.dataType for f in got}, {f.name: f.dataType for f in wanted}
    if set(names) != set(asked):
        raise ConfigError(f"The {side} frame has columns {sorted(names)}, not {sorted(asked)}")
    if odd := [n for n in asked if not same_type(names[n], asked[n])]:
        raise ConfigError(f"The {side} frame's columns {odd} have other types than asked for")
