"""Bounded samples that do not gather more than they need, however many rows there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _below(hashed: Column, share: Column) -> Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all values."""
    return hashed.cast("double") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def smallest(rows: DataFrame, most: int, by: list[str], seed: int, each: str | None = None) -> DataFrame:
    """The ``most`` rows with the smallest hash of the columns ``by`` (of each value of ``each``, if given; ties by the
    columns). A first count lets only rows go on whose hash can be that small, four times as many as wanted, so neither the
    driver nor one task sees more than a few times the sample."""
    hashed = F.xxhash64(*by, F.lit(seed))
    share = F.least(F.lit(1.0), F.lit(4.0 * most) / F.col("_rows"))
    if each is None:
        n = rows.count()
        kept = rows.filter(_below(hashed, F.lit(min(1.0, 4.0 * most / n)))) if n else rows
        return kept.orderBy(hashed, *by).limit(most)
    counts = rows.groupBy(F.col(each).alias("_each")).agg(F.count("*").alias("_rows"))
    kept = rows.join(F.broadcast(counts), F.col(each) == F.col("_each")).filter(_below(hashed, share)).drop("_each", "_rows")
    nth = F.row_number().over(Window.partitionBy(each).orderBy(hashed, *by))
    return kept.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
