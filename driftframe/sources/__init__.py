"""Readers for the pruned entry point: callables that read a source with the schema they are given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Reader = Callable[[T.StructType], DataFrame]


def files(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> Reader:
    """Any file format that Spark reads with a schema: parquet, orc, json, csv, avro and others. Formats that store their
    schema read only the columns asked for; csv files need a header to be read by name, which is checked."""

    def read(schema: T.StructType) -> DataFrame:
        if format == "csv":
            whole = spark.read.format(format).options(header="true", **options).load(path)
            return whole.select(*[whole[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema])
        return spark.read.format(format).options(**options).schema(schema).load(path)

    return read


def frame(df: DataFrame) -> Reader:
    """A frame at hand, with nested fields pruned to the schema asked for by a cast of structure, not of values."""
    from driftframe.sources.prune import pruned

    return lambda schema: pruned(df, schema)


def table(spark: SparkSession, name: str) -> Reader:
    return frame(spark.table(name))
