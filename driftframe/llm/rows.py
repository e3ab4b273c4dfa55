"""Rows of documents with whatever columns they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(docs: DataFrame, without: tuple[str, ...] = ("text",)) -> Column:
    """A hash of a row's columns, of any type, by which rows that are alike otherwise are put in an order that reruns share."""
    return F.xxhash64(F.to_json(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in without])))
