"""Readable examples of differences: ``(scope, field, category, key, left, right)``, a bounded number of each kind.

Which examples are kept is decided by key, so runs agree: the first ``max_examples`` of each scope, field and category.
Spark applies that limit before the shuffle as well, and records are rendered after it. Keys and values are JSON: keys a list of levels, innermost first, each an
object of named values or an element's position; values as ``{"v": value}``, with dates and timestamps as text and maps as
objects. Only what differs is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftframe.config import Path
from driftframe.functions.equality import has_map
from driftframe.functions.status import CATEGORIES, DIFFERENT, LEFT_ONLY, MULTIPLE, RIGHT_ONLY, Level, OneSidedScope
from driftframe.operators.project import key as key_struct
from driftframe.operators.project import keyed_rows
from driftframe.plans.plan import ARRAY, LEFT, RIGHT, STRUCT, Field, Plan, ordered

_JSON = {"ignoreNullFields": "false"}
SCHEMA = "scope string, field string, category string, key string, left string, right string"
#: Rows of one key and side that an example of repeated rows lists; with more, their number is given beside them (``rows``).
LISTED = 1000
_SHOWN = (("different", DIFFERENT), ("left_only", LEFT_ONLY), ("right_only", RIGHT_ONLY))


def shown_type(fields: list[Field], side: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(shown_type(f.children, side)) if f.shape == ARRAY else shown_type(f.children, side) if f.shape == STRUCT else f.on(side).type) for f in ordered(fields, side)])


def field_type(f: Field, side: str) -> T.DataType:
    return shown_type(f.children, side) if f.shape == STRUCT else T.ArrayType(shown_type(f.children, side)) if f.shape == ARRAY else f.on(side).type


def shown(value: Column, kind: T.DataType) -> Column:
    """A canonical value in the form in which it is rendered."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].cast("string").alias("key"), shown(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(value, entry))
    if isinstance(kind, T.ArrayType) and _changes(kind.elementType):
        return F.transform(value, lambda e: shown(e, kind.elementType))
    if isinstance(kind, T.StructType) and _changes(kind):
        return F.when(value.isNotNull(), F.struct(*[shown(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def _changes(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _changes(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_changes(f.dataType) for f in kind)
    return has_map(kind) or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def said(value: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(shown(value, kind).alias("v")), _JSON)


def said_key(paths: tuple[Path, ...], fields: list[Field], key: Column) -> Column:
    """A key struct (see ``project.key``) as an object of dotted names."""
    names = []
    for i, path in enumerate(paths):
        f = next(f for f in fields if f.name == path[0])
        for name in path[1:]:
            f = next(c for c in f.children if c.name == name)
        names.append(shown(key[f"k{i}"], (f.left or f.right).type).alias(".".join(path)))
    return F.to_json(F.struct(*names), _JSON)


def _row(scope: str, field: str, name: str, when: Column, key: Column, left: Column, right: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(scope).alias("scope"), F.lit(field).alias("field"), F.lit(name).alias("category"), key.alias("key"), (none if name == "right_only" else left).alias("left"), (none if name == "left_only" else right).alias("right")))


def _inside(record: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        record = record[name]
    return record


def _field_rows(level: Level, get, key: Column, left: Column, right: Column) -> list[Column]:  # noqa: ANN001
    out = []
    for c in level.counted:
        if c.slot is None or c.of.is_key or c.slot.startswith("n"):
            continue
        value = lambda record, side, c=c: said(_inside(record, c.path), field_type(c.of, side)) if c.of.on(side) is not None and c.kind in ("common", side) else F.lit(None).cast("string")
        codes = {name: code for name, code in CATEGORIES[c.kind] if code != 1}
        out += [_row(c.scope, c.name, name, get(c.slot) == code, key, value(left, LEFT), value(right, RIGHT)) for name, code in codes.items()]
    return out


def examples(judged: DataFrame, root: Level, lone: list[OneSidedScope], plan: Plan, left: DataFrame, right: DataFrame) -> DataFrame:
    most = plan.config.max_examples
    root_key = said_key(plan.keys, plan.fields, F.col("key"))
    types = {side: shown_type(plan.fields, side) for side in (LEFT, RIGHT)}
    record = [_row("", "", name, F.col("c") == code, F.concat(F.lit("["), root_key, F.lit("]")), said(F.col("left"), types[LEFT]), said(F.col("right"), types[RIGHT])) for name, code in _SHOWN]
    tests = [F.col("c") == code for _, code in _SHOWN] + _field_tests(root, F.col)
    tables = [_limited(judged, root_key, tests, record + _field_rows(root, F.col, F.concat(F.lit("["), root_key, F.lit("]")), F.col("left"), F.col("right")), most)]
    for level in root.every()[1:]:
        tables.append(_level_examples(judged, level, root_key, plan))
    for s in lone:
        tables.append(_lone_examples(judged, s, root_key))
    for level in root.every():
        for c in level.counted:
            if c.slot and c.slot.startswith("n"):
                tables.append(_lone_examples(judged, OneSidedScope(level, c.scope, c.kind, c.slot, c.of, c.path), root_key, c.name))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    nth = F.row_number().over(Window.partitionBy("scope", "field", "category").orderBy("key", "left", "right"))
    kept = out.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")
    return kept.unionByName(_multiple(judged, plan, left, right, most))


def _field_tests(level: Level, get) -> list[Column]:  # noqa: ANN001
    """When each of ``_field_rows`` is an example."""
    return [get(c.slot) == code for c in level.counted if not (c.slot is None or c.of.is_key or c.slot.startswith("n")) for _, code in CATEGORIES[c.kind] if code != 1]


def _limited(judged: DataFrame, root_key: Column, tests: list[Column], rows: list[Column], most: int) -> DataFrame:
    """The first ``most`` of each of ``rows``, by key. Which records these are is settled by keys alone; only they are rendered."""
    marked = judged.select(root_key.alias("key"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))).alias("i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("key"))
    kept = marked.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("key").agg(F.collect_set("i").alias("wanted"))
    chosen = judged.withColumn("said", root_key).join(F.broadcast(kept.withColumnRenamed("key", "said")), "said")  # at most `most` keys a kind of example
    return _exploded(chosen, [F.when(F.array_contains("wanted", i), r) for i, r in enumerate(rows)])


def _exploded(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("x")).filter("x is not null").select("x.*")


def _level_chain(level: Level) -> list[Level]:
    return [] if level.array is None else [*_level_chain(level.parent), level]


def _elements(judged: DataFrame, level: Level, root_key: Column) -> DataFrame:
    """``(keys, e)``: a level's records, with the keys of the levels above, innermost first."""
    chain = _level_chain(level)
    if not chain:
        return judged.select(root_key.alias("keys"), F.struct(*[F.col(c) for c in judged.columns]).alias("e"))
    rows = judged.select(root_key.alias("keys"), F.explode(chain[0].slot).alias("e"))
    for i, step in enumerate(chain):
        own = said_key(step.array.keyed.keys, step.array.children, F.col("e.key")) if step.keyed else F.col("e.key").cast("string")
        rows = rows.select(F.concat_ws(",", own, "keys").alias("keys"), "e")
        if i + 1 < len(chain):
            rows = rows.select("keys", F.explode(F.col("e")[chain[i + 1].slot]).alias("e"))
    return rows


def _level_examples(judged: DataFrame, level: Level, root_key: Column, plan: Plan) -> DataFrame:
    rows = _elements(judged, level, root_key)
    key, get = F.concat(F.lit("["), F.col("keys"), F.lit("]")), lambda n: F.col("e")[n]
    types = {side: shown_type(level.array.children, side) for side in (LEFT, RIGHT)}
    field = "" if level.keyed else level.array.element
    own = [_row(level.scope, field, name, get("c") == code, key, said(get("left"), types[LEFT]), said(get("right"), types[RIGHT])) for name, code in _SHOWN]
    if level.keyed:
        several = {side: T.ArrayType(types[side]) for side in (LEFT, RIGHT)}
        own.append(_row(level.scope, "", "multiple_matches", get("c") == MULTIPLE, key, said(get("lefts"), several[LEFT]), said(get("rights"), several[RIGHT])))
    return _exploded(rows, own + _field_rows(level, get, key, get("left"), get("right")))


def _lone_examples(judged: DataFrame, s: OneSidedScope, root_key: Column, field: str = "") -> DataFrame:
    """Elements of a one-sided array of structs, in the root record or in elements of other arrays."""
    rows = _elements(judged, s.level, root_key).filter(F.col("e")[s.slot].isNotNull())
    rows = rows.select("keys", F.posexplode(_inside(F.col("e")[s.side], s.path)).alias("at", "x")).filter("x is not null")
    own = said_key(s.of.keyed.keys, s.of.children, key_struct(s.of.keyed.keys, F.col("x"))) if s.of.keyed else F.col("at").cast("string")
    value = said(F.col("x"), shown_type(s.of.children, s.side))
    name = "left_only" if s.side == LEFT else "right_only"
    return rows.select(_row(s.scope, field, name, F.lit(True), F.concat(F.lit("["), own, F.lit(","), F.col("keys"), F.lit("]")), value, value).alias("x")).select("x.*")


def _multiple(judged: DataFrame, plan: Plan, left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """The rows of keys that have several: of the sampled keys, the first ``LISTED`` as rendered, and how many there are."""
    root_key = F.concat(F.lit("["), said_key(plan.keys, plan.fields, F.col("key")), F.lit("]"))
    sampled = judged.filter(F.col("c") == MULTIPLE).select("key").orderBy(root_key).limit(most)
    sides = []
    for side, df in ((LEFT, left), (RIGHT, right)):
        rows = keyed_rows(df, plan, side).join(F.broadcast(sampled), "key")  # at most max_examples keys
        rows = rows.select("key", F.to_json(shown(F.col("rec"), shown_type(plan.fields, side)), _JSON).alias("row"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("row"))
        listed = rows.withColumn("nth", nth).filter(F.col("nth") <= LISTED).groupBy("key").agg(F.array_sort(F.collect_list("row")).alias(side))
        sides.append(listed.join(rows.groupBy("key").agg(F.count("*").alias(f"{side}_n")), "key"))
    both = sampled.join(sides[0], "key", "left").join(sides[1], "key", "left")
    more = lambda side: F.when(F.col(f"{side}_n") > LISTED, F.concat(F.lit(',"rows":'), F.col(f"{side}_n"))).otherwise("")
    listed = lambda side: F.concat(F.lit('{"v":['), F.coalesce(F.array_join(side, ","), F.lit("")), F.lit("]"), F.coalesce(more(side), F.lit("")), F.lit("}"))
    return both.select(F.lit("").alias("scope"), F.lit("").alias("field"), F.lit("multiple_matches").alias("category"), root_key.alias("key"), listed(LEFT).alias("left"), listed(RIGHT).alias("right"))
