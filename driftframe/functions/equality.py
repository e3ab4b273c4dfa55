"""Equality of two values as a column expression that is never null for values that are not null.

Values are canonical (see ``canonical``): maps are arrays of entries sorted by key, so that ``=`` compares every type, nulls
inside containers being equal, NaN being equal to itself and zeros of both signs being equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftframe.config import ConfigError, Tolerance

_TOLERANT = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_PLAIN = (*_TOLERANT, T.ByteType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def check_comparable(kind: T.DataType) -> None:
    if isinstance(kind, T.ArrayType):
        check_comparable(kind.elementType)
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, _PLAIN):
            raise ConfigError(f"Maps keyed by {kind.keyType.simpleString()} cannot be compared")
        check_comparable(kind.valueType)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            check_comparable(f.dataType)
    elif not isinstance(kind, _PLAIN):
        raise ConfigError(f"Values of type {kind.simpleString()} cannot be compared")


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)


def tolerates(kind: T.DataType, tolerance: Tolerance) -> bool:
    """Whether ``tolerance`` changes anything for values of this type."""
    if tolerance.strict:
        return False
    if isinstance(kind, T.ArrayType):
        return tolerates(kind.elementType, tolerance)
    if isinstance(kind, T.MapType):
        return tolerates(kind.valueType, tolerance)
    if isinstance(kind, T.StructType):
        return any(tolerates(f.dataType, tolerance) for f in kind.fields)
    return isinstance(kind, _TOLERANT)


def canonical(value: Column, kind: T.DataType) -> Column:
    """``value`` with every map, at any depth, as an array of (key, value) structs sorted by key."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entries = F.map_entries(value)
        if has_map(kind.valueType):
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: canonical(e, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def close(left: Column, right: Column, tolerance: Tolerance) -> Column:
    """Whether two numbers that are not equal are within the tolerances, compared as doubles. A relative difference is taken
    against the smaller magnitude, so zero is relatively close to nothing else."""
    x, y = left.cast("double"), right.cast("double")
    distance, tests = F.abs(x - y), []
    if tolerance.active_absolute is not None:
        tests.append(distance <= F.lit(tolerance.active_absolute))
    if tolerance.active_relative is not None:
        tests.append(F.coalesce(F.try_divide(distance, F.least(F.abs(x), F.abs(y))) <= F.lit(tolerance.active_relative), F.lit(False)))
    if len(tests) == 2:
        return tests[0] | tests[1] if tolerance.satisfies == "any" else tests[0] & tests[1]
    return tests[0]


def equal(left: Column, right: Column, kind: T.DataType, tolerance: Tolerance) -> Column:
    """Equality of two canonical values of type ``kind`` that are not null."""
    if not tolerates(kind, tolerance):
        return left == right
    if isinstance(kind, T.ArrayType):
        return (F.size(left) == F.size(right)) & F.forall(F.zip_with(left, right, lambda x, y: equal_or_null(x, y, kind.elementType, tolerance)), lambda e: e)
    if isinstance(kind, T.MapType):
        same = lambda x, y: (x["key"] == y["key"]) & equal_or_null(x["value"], y["value"], kind.valueType, tolerance)
        return (F.size(left) == F.size(right)) & F.forall(F.zip_with(left, right, lambda x, y: F.coalesce(same(x, y), F.lit(False))), lambda e: e)
    if isinstance(kind, T.StructType):
        out = F.lit(True)
        for f in kind.fields:
            out = out & equal_or_null(left[f.name], right[f.name], f.dataType, tolerance)
        return out
    return (left == right) | close(left, right, tolerance)


def equal_or_null(left: Column, right: Column, kind: T.DataType, tolerance: Tolerance) -> Column:
    """As ``equal``, for values that may be null: null equals null only."""
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(equal(left, right, kind, tolerance))
