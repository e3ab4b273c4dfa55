"""The match of both sides by key.

Each side is first reduced to one row a key: how many rows it has, one of them, and, if repeated rows may be left out, whether
all are equal. That is a partial aggregate, so a key with very many rows is reduced before it is shuffled, and no list of rows
is built. The reduced sides meet in a full outer join, which reads the aggregates' exchanges and sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.functions.status import DIFFERENT, LEFT_ONLY, MULTIPLE, RIGHT_ONLY, Level, array_flags, flags_of, leaves, statuses, verdict
from driftframe.operators.project import keyed_rows
from driftframe.plans.plan import LEFT, RIGHT, Plan

KINDS = (("content", DIFFERENT), ("left_only", LEFT_ONLY), ("right_only", RIGHT_ONLY), ("left_and_right_only", LEFT_ONLY | RIGHT_ONLY))


def reduced(df: DataFrame, plan: Plan, side: str) -> DataFrame:
    """``(key, <side>, <side>_many)``: one row a key, ``many`` if it stands for rows that may not be left out."""
    rows = keyed_rows(df, plan, side)
    if plan.config.omit_if_all_identical:
        out = rows.groupBy("key").agg(F.min("rec").alias(side), F.max("rec").alias("most"))
        return out.select("key", side, (F.col(side) != F.col("most")).alias(f"{side}_many"))
    return rows.groupBy("key").agg(F.first("rec").alias(side), (F.count("*") > 1).alias(f"{side}_many"))


def matched(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """``(key, left, right, c)`` with the record's category so far; pairs have none yet."""
    both = reduced(left, plan, LEFT).join(reduced(right, plan, RIGHT), "key", "full_outer")
    many = F.coalesce("left_many", F.lit(False)) | F.coalesce("right_many", F.lit(False))
    c = F.when(many, MULTIPLE).when(F.col("right_many").isNull(), LEFT_ONLY).when(F.col("left_many").isNull(), RIGHT_ONLY)
    return both.select("key", "left", "right", c.alias("c"))


def judged(pairs: DataFrame, root: Level, values: bool = False) -> DataFrame:
    """Each matched key with its category, flags, and the slots of the root level. ``values``: keep keys and records."""
    guard, kept = F.col("c").isNull(), ["key", "left", "right"] if values else []
    out = pairs.select("c", *kept, *leaves(root, root.fields, F.col("left"), F.col("right"), guard, values))
    if root.below:
        out = out.select("*", *array_flags(root, F.col))
    out = out.select("c", *kept, flags_of(root, root.fields, F.col).alias("flags"), *statuses(root, root.fields, F.col))
    return out.withColumn("c", F.coalesce("c", verdict(F.col("flags"))))


def kind_of(flags: Column) -> Column:
    """In what way a different record differs: ``DIFFERENT`` if a value does, else the one-sided flags; 0 if only repeated
    elements make it different."""
    own = flags.bitwiseAND(DIFFERENT | LEFT_ONLY | RIGHT_ONLY)
    return F.when(own.bitwiseAND(DIFFERENT) != 0, DIFFERENT).otherwise(own)
