"""Exact counts of all statuses, from one aggregate over the judged keys: ``(scope, field, kind, category, n)``.

``scope`` is empty for the root, or a keyed array's path; ``field`` is empty for records. Every field is there, with zeros if
need be, also for empty inputs. Elements of arrays are counted in their row, so nothing is exploded or shuffled for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.functions.status import CATEGORIES, DIFFERENT, MULTIPLE, Level, OneSidedScope
from driftframe.operators.match import KINDS, kind_of
from driftframe.plans.plan import LEFT

RECORD = (*CATEGORIES["common"], ("multiple_matches", MULTIPLE))
Row = tuple[str, str, str, str, Column | None]


def level_array(level: Level) -> Column:
    """All elements of a level in one row, whatever arrays they are in."""
    if level.parent.parent is None and level.parent.array is None:
        return F.col(level.slot)
    inner = F.filter(F.transform(level_array(level.parent), lambda e: e[level.slot]), lambda a: a.isNotNull())
    return F.flatten(inner)


def counter(level: Level) -> Callable[[Callable[[Callable[[str], Column]], Column]], Column]:
    """How many of the level's records, over all rows, meet a condition on their slots."""
    if level.array is None:
        return lambda test: F.count_if(test(F.col))
    array = level_array(level)
    return lambda test: F.sum(F.when(array.isNotNull(), F.size(F.filter(array, lambda e: F.coalesce(test(lambda n: e[n]), F.lit(False))))).otherwise(0))


def total(level: Level, slot: str) -> Column:
    if level.array is None:
        return F.sum(slot)
    return F.sum(F.aggregate(level_array(level), F.lit(0), lambda a, e: a + F.coalesce(e[slot], F.lit(0))))


def record_rows(scope: str, count: Callable) -> list[Row]:
    out: list[Row] = [(scope, "", "record", name, count(lambda get, code=code: get("c") == code)) for name, code in RECORD]
    return out + [(scope, "", "kind", name, count(lambda get, code=code: (get("c") == DIFFERENT) & (kind_of(get("flags")) == code))) for name, code in KINDS]


def count_rows(root: Level, lone: list[OneSidedScope]) -> list[Row]:
    out: list[Row] = []
    for level in root.every():
        count = counter(level)
        if level.array is None or level.keyed:
            out += record_rows(level.scope, count)
        else:
            out += [(level.scope, level.array.element, "common", name, count(lambda get, code=code: get("c") == code)) for name, code in CATEGORIES["common"]]
        for f in level.counted:
            for name, code in CATEGORIES[f.kind]:
                if f.slot is None or (f.slot.startswith("n") and name == "nulls"):
                    n = None
                elif f.slot.startswith("n"):
                    n = total(level, f.slot)
                else:
                    n = count(lambda get, slot=f.slot, code=code: get(slot) == code)
                out.append((f.scope, f.name, f.kind, name, n))
    for s in lone:
        only = "left_only" if s.side == LEFT else "right_only"
        out.append((s.scope, "", s.side, only, total(s.level, s.slot)))
        out += [(s.scope, name, s.side, only, None) for name in s.of.names_below()]
    return out


def counts(judged: DataFrame, root: Level, lone: list[OneSidedScope]) -> DataFrame:
    rows = count_rows(root, lone)
    wide = judged.agg(*[F.coalesce(F.lit(0) if n is None else n, F.lit(0)).cast("long").alias(f"n{i}") for i, (*_, n) in enumerate(rows)])
    # an unpivot passes no constraints on: else a filter on top would have the optimizer derive them from every status column
    long = wide.unpivot([], wide.columns, "counter", "n")
    names = ("scope", "field", "kind", "category")
    said = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(row, names)]) for row in rows])
    of = F.get(said, F.substring("counter", 2, 9).cast("int"))
    return long.select(*[of[c].alias(c) for c in names], "n")
