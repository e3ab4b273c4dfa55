"""Queries for cases that the tables do not hold by themselves: null elements, repeated keys, structs inside values, examples of
each kind, files, schemas, refused configurations, the result as objects. Both sides are made from one table by arithmetic on its
key, and the SQL counts from that arithmetic alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from driftframe.api import check_read, diff, diff_pruned
from driftframe.config import ConfigError, DiffConfig
from driftframe.durable import scratch
from driftframe.plans.plan import LEFT, RIGHT, build_plan
from driftframe.sources import files, frame

Made = Callable[[SparkSession, str], DataFrame]
_COMMON = ("identical", "different", "left_only", "right_only")
_RECORD = (*_COMMON, "multiple_matches")
_KIND = ("content", "left_only", "right_only", "left_and_right_only")


def _sides(spark: SparkSession, sf_dir: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "CAST(p_size AS BIGINT) AS size")
    return tuple(part.selectExpr("k", *columns.split(" ; ")) for columns in (left, right))


def _counts(left: str, right: str, config: dict[str, Any]) -> Made:
    return lambda spark, sf_dir: diff(*_sides(spark, sf_dir, left, right), {"keys": ["k"]} | config).counts()


def _examples(left: str, right: str, config: dict[str, Any]) -> Made:
    return lambda spark, sf_dir: diff(*_sides(spark, sf_dir, left, right), {"keys": ["k"]} | config).examples()


def _sql(rows: Iterable[tuple[str, str, str, dict[str, str], tuple[str, ...]]]) -> str:
    """Counts of ``(scope, field, kind, what to sum for a category, categories)`` over the rows of part."""
    said = [
        f"SELECT '{scope}' AS scope, '{field}' AS field, '{kind}' AS kind, '{c}' AS category, CAST(coalesce(sum({sums.get(c, '0')}), 0) AS BIGINT) AS n FROM p"
        for scope, field, kind, sums, categories in rows for c in categories
    ]
    return f"WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part) SELECT * FROM ({' UNION ALL '.join(said)}) o"


def _if(test: str) -> str:
    return f"CAST(({test}) AS INT)"


def _same(test: str) -> dict[str, str]:
    return {"identical": _if(test), "different": _if(f"NOT ({test})")}


# --- elements that are null, keys that repeat, structs inside maps and arrays of arrays ---

_NULLS = tuple(f"array(named_struct('i', 1, 'x', size), CASE WHEN k % {n} = 0 THEN NULL ELSE named_struct('i', 2, 'x', size) END, named_struct('i', 3, 'x', {x})) AS a" for n, x in ((3, "7"), (2, "CASE WHEN k % 5 = 0 THEN 8 ELSE 7 END")))
_BOTH, _NONE, _ONLY_LEFT, _ONLY_RIGHT = "k % 3 <> 0 AND k % 2 <> 0", "k % 6 = 0", "k % 3 <> 0 AND k % 2 = 0", "k % 3 = 0 AND k % 2 <> 0"
_EVEN_NULLS = f"(({_BOTH}) OR ({_NONE}))"
_KEY = ("", "k", "common", {"identical": "1"}, _COMMON)
_BY_I = {"exploded-arrays": {"a": {"keys": ["i"]}}}


def _null_rows(keyed: bool) -> list:
    alike = f"{_EVEN_NULLS} AND k % 5 <> 0"
    if keyed:  # a different number of null elements makes the array different
        kinds = {"content": _if(f"NOT ({alike})")}
    else:
        kinds = {"content": _if("k % 5 = 0"), "left_only": _if(f"k % 5 <> 0 AND {_ONLY_LEFT}"), "right_only": _if(f"k % 5 <> 0 AND {_ONLY_RIGHT}")}
    pairs = f"1 + {_if(_BOTH)}"
    elements = {"identical": f"{pairs} + {_if('k % 5 <> 0')}" + ("" if keyed else f" + {_if(_NONE)}"), "different": _if("k % 5 = 0"), "left_only": _if(_ONLY_LEFT), "right_only": _if(_ONLY_RIGHT)}
    out = [("", "", "record", _same(alike), _RECORD), ("", "", "kind", kinds, _KIND), _KEY, ("", "a", "common", _same(alike), _COMMON)]
    scope, prefix = ("a", "") if keyed else ("", "a.")
    out += [("a", "", "record", elements, _RECORD), ("a", "", "kind", {"content": _if("k % 5 = 0")}, _KIND)] if keyed else [("", "a (struct)", "common", elements, _COMMON)]
    out += [(scope, f"{prefix}i", "common", {"identical": f"{pairs} + 1"}, _COMMON), (scope, f"{prefix}x", "common", {"identical": f"{pairs} + {_if('k % 5 <> 0')}", "different": _if("k % 5 = 0")}, _COMMON)]
    return out


_TWICE = tuple(f"array(named_struct('i', 1, 'x', size), named_struct('i', 1, 'x', {x})) AS a" for x in ("size + 1", "CASE WHEN k % 2 = 0 THEN size + 1 ELSE size + 2 END"))
_EVEN = "k % 2 = 0"
_TWICE_ROWS = [
    ("", "", "record", _same(_EVEN), _RECORD), ("", "", "kind", {}, _KIND), _KEY, ("", "a", "common", _same(_EVEN), _COMMON),
    ("a", "", "record", {"identical": f"2 * {_if(_EVEN)}", "multiple_matches": _if(f"NOT ({_EVEN})")}, _RECORD), ("a", "", "kind", {}, _KIND),
    ("a", "i", "common", {"identical": f"2 * {_if(_EVEN)}"}, _COMMON), ("a", "x", "common", {"identical": f"2 * {_if(_EVEN)}"}, _COMMON),
]

_STRUCTS = tuple(f"map('a', named_struct('x', k, 'y', {y})) AS m ; array(array(named_struct('x', k, 'y', {y}))) AS n ; map('a', map(k, named_struct('y', {y}))) AS d" for y in ("size", "CASE WHEN k % 7 = 0 THEN NULL ELSE size + k % 5 END"))
_NEAR = "k % 7 <> 0 AND k % 5 <= 2"
_STRUCT_ROWS = [("", "", "record", _same(_NEAR), _RECORD), ("", "", "kind", {"content": _if(f"NOT ({_NEAR})")}, _KIND), _KEY, *(("", f, "common", _same(_NEAR), _COMMON) for f in "mnd")]

# --- examples ---


def _shown(rows: Iterable[tuple[str, str, str, str, str | None, str | None, str]], most: int) -> str:
    """The first ``most`` by key of each ``(scope, field, category, key, left, right, when)``; key and values are SQL."""
    said = [
        f"SELECT * FROM (SELECT '{scope}' AS scope, '{field}' AS field, '{category}' AS category, {key} AS key, CAST({left or 'NULL'} AS VARCHAR) AS left, CAST({right or 'NULL'} AS VARCHAR) AS right FROM p WHERE {when} ORDER BY {key} LIMIT {most}) q{i}"
        for i, (scope, field, category, key, left, right, when) in enumerate(rows)
    ]
    return f"WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part) {' UNION ALL '.join(said)}"


def _root(*inner: str) -> str:
    return f"'[{''.join(i + ',' for i in inner)}{{\"k\":' || k || '}}]'"


def _value(json: str) -> str:
    """JSON in which <sql> stands for a value."""
    return "'{\"v\":" + json.replace("<", "' || ").replace(">", " || '") + "}'"


_SHOWN_L, _SHOWN_R = (f"DATE'2024-01-01' + CAST(k % {n} AS INT) AS day ; map('a', k % {m}) AS m ; CAST(k % {m} AS DECIMAL(10,2)) AS d" for n, m in ((3, 3), (6, 4)))


def _readable(day: str, m: str) -> tuple[str, str, str]:
    date = f"<strftime(DATE '2024-01-01' + CAST(k % {day} AS INT), '%Y-%m-%d')>"
    return f'"{date}"', f'{{"a":<k % {m}>}}', f"<k % {m}>.00"


def _readable_sql() -> str:
    (dl, ml, nl), (dr, mr, nr) = _readable("3", "3"), _readable("6", "4")
    whole = lambda d, m, n: _value(f'{{"k":<k>,"day":{d},"m":{m},"d":{n}}}')
    days, maps = "k % 3 <> k % 6", "k % 3 <> k % 4"
    rows = [("", "", "different", _root(), whole(dl, ml, nl), whole(dr, mr, nr), f"{days} OR {maps}"), ("", "day", "different", _root(), _value(dl), _value(dr), days)]
    return _shown([*rows, ("", "m", "different", _root(), _value(ml), _value(mr), maps), ("", "d", "different", _root(), _value(nl), _value(nr), maps)], 9)


def examples_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir, "size + 100 AS x", "size + 100 AS x")
    more = left.filter("k % 10 = 0").selectExpr("k", "x + 1 AS x")
    return diff(left.unionByName(more), right.filter("k % 20 <> 0"), {"keys": ["k"], "max-examples": 7}).examples()


_LISTED = [("", "", "multiple_matches", _root(), _value('[{"k":<k>,"x":<size + 100>},{"k":<k>,"x":<size + 101>}]'), f"CASE WHEN k % 20 = 0 THEN '{{\"v\":[]}}' ELSE {_value('[{"k":<k>,"x":<size + 100>}]')} END", "k % 10 = 0")]

_SEVERAL = "array(named_struct('i', 1, 'x', 100), named_struct('i', 1, 'x', 200)) AS a", "CASE WHEN k % 10 = 0 THEN array(named_struct('i', 1, 'x', 300)) ELSE array(named_struct('i', 1, 'x', 100), named_struct('i', 1, 'x', 200)) END AS a"
_TWO, _ONE = '[{"i":1,"x":100},{"i":1,"x":200}]', '[{"i":1,"x":300}]'
_SEVERAL_ROWS = [
    ("", "", "different", _root(), _value(f'{{"k":<k>,"a":{_TWO}}}'), _value(f'{{"k":<k>,"a":{_ONE}}}'), "k % 10 = 0"), ("", "a", "different", _root(), _value(_TWO), _value(_ONE), "k % 10 = 0"),
    ("a", "", "multiple_matches", _root('{"i":1}'), _value('[{"i":1,"x":200},{"i":1,"x":100}]'), _value(_ONE), "k % 10 = 0"),
]

_LONE = "array(named_struct('i', 1, 'x', 5)) AS a", "array(named_struct('i', 1, 'x', 5, 'z', CASE WHEN k % 3 = 0 THEN array(named_struct('j', 2, 'y', 7)) END)) AS a"
_Z = '[{"j":2,"y":7}]'
_LONE_ROWS = [
    ("", "", "different", _root(), _value('{"k":<k>,"a":[{"i":1,"x":5}]}'), _value(f'{{"k":<k>,"a":[{{"i":1,"x":5,"z":{_Z}}}]}}'), "k % 3 = 0"),
    ("", "a", "different", _root(), _value('[{"i":1,"x":5}]'), _value(f'[{{"i":1,"x":5,"z":{_Z}}}]'), "k % 3 = 0"),
    ("a", "", "different", _root('{"i":1}'), _value('{"i":1,"x":5}'), _value(f'{{"i":1,"x":5,"z":{_Z}}}'), "k % 3 = 0"),
    ("a", "z", "right_only", _root('{"i":1}'), None, _value(_Z), "k % 3 = 0"), ("a.z", "", "right_only", _root('{"j":2}', '{"i":1}'), None, _value('{"j":2,"y":7}'), "k % 3 = 0"),
]

# --- files, schemas, refused configurations, the result as objects ---

FORMATS = ("parquet", "orc", "json", "csv")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from files of each format against Parquet, through the entry point that prunes."""
    left, right = _sides(spark, sf_dir, "size ; concat('p', k) AS name ; named_struct('a', size) AS s", "CASE WHEN k % 13 = 0 THEN size + 1 ELSE size END AS size ; concat('p', k) AS name ; named_struct('a', size) AS s")
    out = None
    for kind in FORMATS:
        l, r = (x.drop("s") if kind == "csv" else x for x in (left, right))  # noqa: E741
        paths = [scratch(spark), scratch(spark)]
        l.write.parquet(paths[0])
        r.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(paths[1])
        made = diff_pruned(files(spark, paths[0]), files(spark, paths[1], kind), l.schema, r.schema, {"keys": ["k"], "ignore": {"fields": ["name"]}})
        rows = made.counts().filter("field <> 's' AND field <> 's.a'").selectExpr(f"'{kind}' AS format", "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_FILE_ROWS = [("", "", "record", _same("k % 13 <> 0"), _RECORD), ("", "", "kind", {"content": _if("k % 13 = 0")}, _KIND), _KEY, ("", "size", "common", _same("k % 13 <> 0"), _COMMON)]


def reported_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the result says of both schemas: aliased, without what is ignored, common fields first."""
    left, right = _sides(spark, sf_dir, "size AS l_size ; concat('p', k) AS name ; named_struct('a', size, 'b', k) AS s", "named_struct('b', k, 'c', size) AS s ; size ; true AS flag")
    plan = build_plan(left.schema, right.schema, DiffConfig.from_dict({"keys": ["k"], "left-aliases": {"l_size": "size"}, "ignore": {"fields": ["name"]}}))
    rows = [(side, i, f.name, f.dataType.simpleString()) for side in (LEFT, RIGHT) for i, f in enumerate(plan.reported_schema(side))]
    return spark.createDataFrame(rows, "side string, place int, name string, type string")


_REPORTED = "SELECT * FROM (VALUES ('left', 0, 'k', 'bigint'), ('left', 1, 'size', 'bigint'), ('left', 2, 's', 'struct<b:bigint,a:bigint>'), ('right', 0, 'k', 'bigint'), ('right', 1, 'size', 'bigint'), ('right', 2, 's', 'struct<b:bigint,c:bigint>'), ('right', 3, 'flag', 'boolean')) v(side, place, name, type)"
_CASES = ("accepted", "ignored key", "ignored key of a keyed array", "missing key", "key on one side", "key that is a struct", "nothing in common", "keyed array without keys", "tolerance that sets nothing", "unknown word", "not JSON", "columns missing after the read", "other types after the read")


def rejected_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir, "size ; named_struct('i', k) AS s ; array(named_struct('i', 1, 'x', size)) AS a ; size AS only_left", "size ; named_struct('i', k) AS s ; array(named_struct('i', 1, 'x', size)) AS a")
    plan = lambda config, l=left, r=right: build_plan(l.schema, r.schema, DiffConfig.from_dict(config))  # noqa: E731, E741
    tries: dict[str, Callable[[], Any]] = dict(zip(_CASES, (
        lambda: plan({"keys": ["k"]}), lambda: plan({"keys": ["k"], "ignore": {"fields": ["k"]}}), lambda: plan({"keys": ["k"], "ignore": {"fields": ["a.i"]}} | _BY_I), lambda: plan({"keys": ["other"]}),
        lambda: plan({"keys": ["only_left"]}), lambda: plan({"keys": ["s"]}), lambda: plan({"keys": ["k"]}, left.selectExpr("size"), right.selectExpr("k")), lambda: plan({"keys": ["k"], "exploded-arrays": {"a": {"keys": []}}}),
        lambda: plan({"keys": ["k"], "tolerances": {"size": {}}}), lambda: plan({"keys": ["k"], "default-tolerance": {"satisfies": "some"}}), lambda: DiffConfig.from_json("keys = k"),
        lambda: diff_pruned(frame(left), lambda wanted: right.select("k"), left.schema, right.schema, {"keys": ["k"]}), lambda: check_read(left.selectExpr("k", "CAST(size AS STRING) AS size").schema, left.select("k", "size").schema, LEFT),
    )))
    rows = []
    for case, attempt in tries.items():
        try:
            attempt()
            rows.append((case, False))
        except ConfigError:
            rows.append((case, True))
    return spark.createDataFrame(rows, "case_name string, rejected boolean")


_REJECTED = f"SELECT * FROM (VALUES {', '.join(f"('{c}', {str(c != 'accepted').lower()})" for c in _CASES)}) v(case_name, rejected)"


def whole_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run()`` as rows: each count with how many examples it has and the first of them."""
    left, right = _sides(spark, sf_dir, "CASE WHEN k % 5 = 0 THEN NULL ELSE size END AS size ; size AS lone", "CASE WHEN k % 3 = 0 THEN size + 1 ELSE size END AS size")
    done = diff(left, right, {"keys": ["k"], "max-examples": 4}).run()
    cells = [("record", "", c, v) for c, v in done.root.records.items()] + [(f.kind, name, c, v) for name, f in done.root.fields.items() for c, v in f.categories.items()]
    rows = [(kind, field, c, v.count, len(v.examples), str(v.examples[0].key[0]["k"]) if v.examples else None) for kind, field, c, v in cells]
    return spark.createDataFrame(rows, "kind string, field string, category string, n long, shown int, first_key string")


def _whole_sql() -> str:
    tests = [("record", "", {"different": "true"}, _RECORD), ("common", "k", {"identical": "true"}, _COMMON), ("common", "size", {"identical": "k % 5 <> 0 AND k % 3 <> 0", "different": "k % 5 <> 0 AND k % 3 = 0", "right_only": "k % 5 = 0"}, _COMMON), ("left", "lone", {"left_only": "true"}, ("nulls", "left_only"))]
    said = []
    for kind, field, when, categories in tests:
        for c in categories:
            test = when.get(c, "false")
            shown = "0" if c in ("identical", "nulls") else f"least(4, count(*) FILTER (WHERE {test}))"
            first = "NULL" if c in ("identical", "nulls") else f"min(CAST(k AS VARCHAR) || '}}') FILTER (WHERE {test})"
            said.append(f"SELECT '{kind}' AS kind, '{field}' AS field, '{c}' AS category, CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS n, CAST({shown} AS INT) AS shown, rtrim({first}, '}}') AS first_key FROM p")
    return f"WITH p AS (SELECT p_partkey AS k FROM part) {' UNION ALL '.join(said)}"


QUERIES: dict[str, Made] = {
    "struct_array_null_elements": _counts(*_NULLS, {}),
    "exploded_null_elements": _counts(*_NULLS, _BY_I),
    "exploded_equal_repeated": _counts(*_TWICE, _BY_I),
    "structs_in_values": _counts(*_STRUCTS, {"default-tolerance": {"absolute": 2}}),
    "examples_none": _examples("size", "size + 1 AS size", {"max-examples": 0}),
    "examples_readable": _examples(_SHOWN_L, _SHOWN_R, {"max-examples": 9}),
    "examples_multiple": examples_multiple,
    "examples_exploded": _examples(*_SEVERAL, _BY_I | {"max-examples": 6}),
    "examples_one_sided_nested": _examples(*_LONE, {"exploded-arrays": {"a": {"keys": ["i"]}, "a.z": {"keys": ["j"]}}, "max-examples": 5}),
    "file_formats": file_formats,
    "reported_schema": reported_schema,
    "rejected_configurations": rejected_configurations,
    "whole_result": whole_result,
}

SQL: dict[str, str] = {
    "struct_array_null_elements": _sql(_null_rows(False)),
    "exploded_null_elements": _sql(_null_rows(True)),
    "exploded_equal_repeated": _sql(_TWICE_ROWS),
    "structs_in_values": _sql(_STRUCT_ROWS),
    "examples_none": "SELECT '' AS scope, '' AS field, '' AS category, '' AS key, '' AS left, '' AS right WHERE false",
    "examples_readable": _readable_sql(),
    "examples_multiple": _shown(_LISTED, 7),
    "examples_exploded": _shown(_SEVERAL_ROWS, 6),
    "examples_one_sided_nested": _shown(_LONE_ROWS, 5),
    "file_formats": " UNION ALL ".join(f"SELECT '{kind}' AS format, * FROM ({_sql(_FILE_ROWS)}) f_{kind}" for kind in FORMATS),
    "reported_schema": _REPORTED,
    "rejected_configurations": _REJECTED,
    "whole_result": _whole_sql(),
}
