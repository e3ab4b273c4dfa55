"""A side's rows as ``key`` and ``rec``: the group key as one struct that is never null, and the compared fields, aliased,
pruned and canonical, as another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftframe.config import Path
from driftframe.functions.equality import canonical, check_comparable
from driftframe.plans.plan import ARRAY, STRUCT, Field, Plan, ordered


def record(fields: list[Field], side: str, of: Column | None = None) -> Column:
    """The struct of compared fields; ``of`` is the enclosing struct, or none for the row itself."""
    out = []
    for f in ordered(fields, side):
        own = f.on(side)
        value = F.col(f"`{own.name}`") if of is None else of[own.name]
        if f.shape == STRUCT:
            value = F.when(value.isNotNull(), record(f.children, side, value))
        elif f.shape == ARRAY:
            value = F.transform(value, lambda e: F.when(e.isNotNull(), record(f.children, side, e)))  # noqa: B023
        else:
            check_comparable(own.type)
            value = canonical(value, own.type)
        out.append(value.alias(f.name))
    return F.struct(*out)


def key(paths: tuple[Path, ...], rec: Column) -> Column:
    """A struct of the key's leaves, by aliased path. A leaf below a struct comes with whether that struct is null: a null
    parent and a null leaf are different keys. Zeros of both signs are one key."""
    out = []
    for i, path in enumerate(paths):
        value = rec
        for depth, name in enumerate(path):
            value = value[name]
            if depth < len(path) - 1:
                out.append(value.isNull().alias(f"n{i}_{depth}"))
        out.append(value.alias(f"k{i}"))
    return F.struct(*out)


def normal_key(paths: tuple[Path, ...], fields: list[Field], rec: Column) -> Column:
    """``key`` for use inside arrays, where Spark tells zeros of different sign apart."""
    kinds = {p: _type(fields, p) for p in paths}
    out = []
    for i, path in enumerate(paths):
        value = rec
        for depth, name in enumerate(path):
            value = value[name]
            if depth < len(path) - 1:
                out.append(value.isNull().alias(f"n{i}_{depth}"))
        out.append((value + F.lit(0.0).cast(kinds[path]) if isinstance(kinds[path], (T.FloatType, T.DoubleType)) else value).alias(f"k{i}"))
    return F.struct(*out)


def _type(fields: list[Field], path: Path) -> T.DataType:
    f = next(f for f in fields if f.name == path[0])
    return (f.left or f.right).type if len(path) == 1 else _type(f.children, path[1:])


def keyed_rows(df: DataFrame, plan: Plan, side: str) -> DataFrame:
    rec = df.select(record(plan.fields, side).alias("rec"))
    return rec.select(key(plan.keys, F.col("rec")).alias("key"), "rec")
