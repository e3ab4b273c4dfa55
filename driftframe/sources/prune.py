"""Nested column pruning as a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pruned(df: DataFrame, schema: T.StructType) -> DataFrame:
    own = {f.name: f.dataType for f in df.schema}
    return df.select(*[_value(F.col(f"`{f.name}`"), own[f.name], f.dataType).alias(f.name) for f in schema])


def _value(value: Column, own: T.DataType, wanted: T.DataType) -> Column:
    if own.simpleString() == wanted.simpleString():
        return value
    if isinstance(wanted, T.StructType):
        types = {f.name: f.dataType for f in own}
        return F.when(value.isNotNull(), F.struct(*[_value(value[f.name], types[f.name], f.dataType).alias(f.name) for f in wanted]))
    return F.transform(value, lambda e: _value(e, own.elementType, wanted.elementType))
