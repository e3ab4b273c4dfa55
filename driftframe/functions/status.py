"""Statuses of compared fields, as column expressions.

A status is one of the flags below, or null where a field was not compared because an enclosing record is missing on a side.
Flags of all fields are OR-ed upward: they decide whether a struct, an array or a record is identical, and in what way a
record differs.

The comparison is laid out in levels. The root record is a level, with its structs flattened into it; so are the elements of
each array of structs. A level's results are slots: columns at the root, members of an array of structs below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftframe.functions.equality import equal
from driftframe.operators.project import normal_key
from driftframe.plans.plan import ARRAY, COMMON, LEFT, STRUCT, Field, Plan

IDENTICAL, DIFFERENT, LEFT_ONLY, RIGHT_ONLY, MULTIPLE = 1, 2, 4, 8, 16
#: Categories that are counted for each kind of field.
CATEGORIES = {
    "common": (("identical", IDENTICAL), ("different", DIFFERENT), ("left_only", LEFT_ONLY), ("right_only", RIGHT_ONLY)),
    "left": (("nulls", IDENTICAL), ("left_only", LEFT_ONLY)),
    "right": (("nulls", IDENTICAL), ("right_only", RIGHT_ONLY)),
}

Slots = Callable[[str], Column]


@dataclass
class Counted:
    """A reported field whose statuses are in ``slot`` (none: always zero). ``of`` is its plan field."""

    scope: str
    name: str
    kind: str
    slot: str | None
    of: Field
    path: tuple[str, ...] = ()  # from the level's record


@dataclass
class Level:
    scope: str
    fields: list[Field]
    parent: Level | None = None
    slot: str = ""
    array: Field | None = None
    array_path: tuple[str, ...] = ()
    counted: list[Counted] = field(default_factory=list)
    slots: dict[int, str] = field(default_factory=dict)
    below: list[Level] = field(default_factory=list)

    @property
    def keyed(self) -> bool:
        return self.array is not None and self.array.keyed is not None

    def every(self) -> list[Level]:
        return [self, *(x for b in self.below for x in b.every())]


@dataclass
class OneSidedScope:
    """A keyed array that only one side has: its elements are counted in ``slot``, its members only named."""

    level: Level
    scope: str
    side: str
    slot: str
    of: Field
    path: tuple[str, ...]


def lay_out(plan: Plan) -> tuple[Level, list[OneSidedScope]]:
    root, lone = Level("", plan.fields), []
    _lay(root, plan.fields, (), lone)
    return root, lone


def _lay(level: Level, fields: list[Field], path: tuple[str, ...], lone: list[OneSidedScope]) -> None:
    for f in fields:
        slot = level.slots[id(f)] = f"s{len(level.slots)}"
        at = (*path, f.name)
        level.counted.append(Counted(level.scope, f.full, f.kind, slot, f, at))
        if f.shape == STRUCT and f.kind == COMMON:
            _lay(level, f.children, at, lone)
        elif f.shape == ARRAY and f.kind == COMMON:
            below = Level(f.keyed.scope if f.keyed else level.scope, f.children, level, f"e{slot}", f, at)
            level.below.append(below)
            _lay(below, f.children, (), lone)
        elif f.shape == ARRAY and f.keyed:
            lone.append(OneSidedScope(level, f.keyed.scope, f.kind, f"n{slot}", f, at))
        elif f.shape != "atomic":
            if f.shape == ARRAY:
                level.counted.append(Counted(level.scope, f.element, f.kind, f"n{slot}", f, at))
            level.counted += [Counted(level.scope, n, f.kind, None, f) for n in f.names_below()]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside a lambda too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def two_sided(left: Column, right: Column, both: Column) -> Column:
    return F.when(left.isNull() & right.isNull(), IDENTICAL).when(left.isNull(), RIGHT_ONLY).when(right.isNull(), LEFT_ONLY).otherwise(both)


def or_flags(columns: list[Column]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out.bitwiseOR(c)
    return out


def verdict(flags: Column) -> Column:
    return F.when(flags.bitwiseOR(F.lit(IDENTICAL)) == IDENTICAL, IDENTICAL).otherwise(DIFFERENT)


def leaves(level: Level, fields: list[Field], left: Column, right: Column, guard: Column, values: bool) -> list[Column]:
    """The first stage: statuses of what can be compared at once; for structs and arrays on both sides 0, to be decided; and
    the compared elements of arrays. ``guard``: both records are there."""
    out = []
    for f in fields:
        slot = level.slots[id(f)]
        if f.is_key:
            out.append(F.when(guard, IDENTICAL).alias(slot))
        elif f.kind != COMMON:
            value = (left if f.kind == LEFT else right)[f.name]
            out.append(F.when(guard, F.when(value.isNull(), IDENTICAL).otherwise(LEFT_ONLY if f.kind == LEFT else RIGHT_ONLY)).alias(slot))
            if f.shape == ARRAY:
                out.append(F.when(guard & value.isNotNull(), F.size(F.filter(value, lambda e: e.isNotNull()))).alias(f"n{slot}"))
        else:
            x, y = left[f.name], right[f.name]
            both = guard & x.isNotNull() & y.isNotNull()
            if f.shape == STRUCT:
                out.append(F.when(guard, two_sided(x, y, F.lit(0))).alias(slot))
                out += leaves(level, f.children, x, y, both, values)
            elif f.shape == ARRAY:
                below = next(b for b in level.below if b.array is f)
                out.append(F.when(guard, two_sided(x, y, F.lit(0))).alias(slot))
                out.append(F.when(both, elements(below, x, y, values)).alias(below.slot))
                if f.keyed:
                    nulls = lambda a: F.size(F.filter(a, lambda e: e.isNull()))
                    out.append(F.when(both, F.when(nulls(x) == nulls(y), IDENTICAL).otherwise(DIFFERENT)).alias(f"z{slot}"))
            else:
                out.append(F.when(guard, two_sided(x, y, F.when(equal(x, y, f.left.type, f.tolerance), IDENTICAL).otherwise(DIFFERENT))).alias(slot))
    return out


def array_flags(level: Level, get: Slots) -> list[Column]:
    """The second stage: for each array the flags of its elements."""
    out = []
    for b in level.below:
        slot = level.slots[id(b.array)]
        flags = F.aggregate(get(b.slot), F.lit(0), lambda a, e: a.bitwiseOR(e["flags"]))
        out.append((flags.bitwiseOR(get(f"z{slot}")) if b.keyed else flags).alias(f"f{slot}"))
    return out


def flags_of(level: Level, fields: list[Field], get: Slots) -> Column:
    return or_flags([_flags(level, f, get) for f in fields if not f.is_key])


def _flags(level: Level, f: Field, get: Slots) -> Column:
    slot = level.slots[id(f)]
    if f.shape == STRUCT and f.kind == COMMON:
        return F.when(get(slot) == 0, flags_of(level, f.children, get)).otherwise(F.coalesce(get(slot), F.lit(0)))
    if f.shape == ARRAY and f.kind == COMMON:
        return F.when(get(slot) == 0, get(f"f{slot}")).otherwise(F.coalesce(get(slot), F.lit(0)))
    return F.coalesce(get(slot), F.lit(0))


def statuses(level: Level, fields: list[Field], get: Slots) -> list[Column]:
    """The third stage: final statuses, and whatever else is counted."""
    out = []
    for f in fields:
        slot = level.slots[id(f)]
        if f.kind == COMMON and f.shape != "atomic":
            out.append(F.when(get(slot) == 0, verdict(_flags(level, f, get))).otherwise(get(slot)).alias(slot))
        else:
            out.append(get(slot).alias(slot))
        if f.kind != COMMON and f.shape == ARRAY:
            out.append(get(f"n{slot}").alias(f"n{slot}"))
        if f.kind == COMMON and f.shape == STRUCT:
            out += statuses(level, f.children, get)
    return out + ([get(b.slot).alias(b.slot) for b in level.below] if fields is level.fields else [])


def compared(level: Level, left: Column, right: Column, guard: Column, otherwise: tuple[Column, Column], extra: list[Column], values: bool) -> Column:
    """An element's result: its category ``c``, its flags, its slots. ``otherwise``: category and flags if not both are there."""
    first = F.struct(guard.alias("guard"), otherwise[0].cast("int").alias("c"), otherwise[1].cast("int").alias("f"), *leaves(level, level.fields, left, right, guard, values))

    def finish(s: Column, get: Slots) -> Column:
        flags = F.when(s["guard"], flags_of(level, level.fields, get)).otherwise(s["f"])
        return F.struct(F.when(s["guard"], verdict(flags)).otherwise(s["c"]).alias("c"), flags.alias("flags"), *statuses(level, level.fields, get), *extra)

    if not level.below:
        return let(first, lambda s: finish(s, lambda n: s[n]))
    return let(first, lambda s: let(F.struct(*array_flags(level, lambda n: s[n])), lambda a: finish(s, lambda n: a[n] if n in {f"f{level.slots[id(b.array)]}" for b in level.below} else s[n])))


def elements(level: Level, left: Column, right: Column, values: bool) -> Column:
    """The compared elements of two arrays that are not null."""
    return _by_key(level, left, right, values) if level.keyed else _by_position(level, left, right, values)


def _by_position(level: Level, left: Column, right: Column, values: bool) -> Column:
    n = F.greatest(F.size(left), F.size(right))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    in_both = lambda i: (i < F.size(left)) & (i < F.size(right))

    def element(i: Column) -> Column:
        x, y = F.get(left, i), F.get(right, i)
        extra = [i.alias("key"), x.alias("left"), y.alias("right")] if values else []
        alone = F.when(x.isNotNull(), LEFT_ONLY).when(y.isNotNull(), RIGHT_ONLY)
        other = F.when(in_both(i) & x.isNull() & y.isNull(), IDENTICAL).otherwise(alone)
        return compared(level, x, y, x.isNotNull() & y.isNotNull(), (other, F.coalesce(other, F.lit(DIFFERENT))), extra, values)

    return F.transform(places, element)


def _by_key(level: Level, left: Column, right: Column, values: bool) -> Column:
    """Elements meet by key, in place and without a shuffle: both arrays' elements are sorted by key, side and position, and
    each run of one key is a group. Arrays that are equal as a whole pair each element with itself, repeated keys or not."""
    array = level.array
    own_key = lambda e: normal_key(array.keyed.keys, array.children, e)
    there = lambda a: F.filter(a, lambda e: e.isNotNull())
    # the sides' elements may differ in type, so each has a member of its own; the other's is a typed null
    tagged = lambda a, side: F.transform(there(a), lambda e, i: F.struct(own_key(e).alias("k"), F.lit(side).alias("side"), i.alias("at"), *((e if s == side else F.get(other, F.lit(-1))).alias(f"e{s}") for s, other in enumerate((left, right)))))

    def extra(k: Column, x: Column, y: Column, xs: Column, ys: Column) -> list[Column]:
        return [k.alias("key"), x.alias("left"), y.alias("right"), F.reverse(xs).alias("lefts"), F.reverse(ys).alias("rights")] if values else []

    def group(k: Column, xs: Column, ys: Column) -> Column:
        x, y = F.get(xs, F.lit(0)), F.get(ys, F.lit(0))
        if array.keyed.omit:
            alike = lambda a: F.forall(a, lambda e: F.coalesce(e == F.get(a, F.lit(0)), F.lit(False)))
            single = alike(xs) & alike(ys)
        else:
            single = (F.size(xs) < 2) & (F.size(ys) < 2)
        alone = F.when(~single, MULTIPLE).when(F.size(ys) == 0, LEFT_ONLY).when(F.size(xs) == 0, RIGHT_ONLY)
        return compared(level, x, y, single & (F.size(xs) > 0) & (F.size(ys) > 0), (alone, alone), extra(k, x, y, xs, ys), values)

    def runs(all_: Column) -> Column:
        """The runs of one key of the sorted elements."""
        n = F.size(all_)
        key_at = lambda i: F.element_at(all_, i)["k"]
        places = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
        later = F.filter(places, lambda i: ~key_at(i).eqNullSafe(key_at(i - 1)))
        edges = F.when(n > 0, F.concat(F.array(F.lit(1)), later, F.array(n + 1))).otherwise(F.array(F.lit(1)))
        cut = lambda e: F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e)), lambda a, b: F.slice(all_, a, b - a))
        return let(edges, lambda e: F.filter(cut(e), lambda r: r.isNotNull()))

    def matched(all_: Column) -> Column:
        of = lambda run, side: F.transform(F.filter(run, lambda p: p["side"] == side), lambda p: p[f"e{side}"])
        return F.transform(runs(all_), lambda run: let(F.struct(F.element_at(run, 1)["k"].alias("k"), of(run, 0).alias("x"), of(run, 1).alias("y")), lambda g: group(g["k"], g["x"], g["y"])))

    by_key = let(F.sort_array(F.concat(tagged(left, 0), tagged(right, 1))), matched)
    if not _same_fields(array.children):
        return by_key
    itself = F.transform(there(left), lambda e: let(e, lambda x: compared(level, x, x, F.lit(True), (F.lit(None), F.lit(None)), extra(own_key(x), x, x, F.array(x), F.array(x)), values)))
    return F.when(left == right, itself).otherwise(by_key)


def _same_fields(fields: list[Field]) -> bool:
    return all(f.kind == COMMON and _same_fields(f.children) for f in fields)
