"""Hand-written cases with known results; each runs with swapped sides too."""

import datetime as dt

import pytest
from helpers import counted, results, rows

from driftframe.api import diff, diff_pruned
from driftframe.config import ConfigError
from driftframe.sources import files, frame

KEY = {"keys": ["key"]}
BASE = "key string, user string, shorty smallint, count int, size bigint, value float, total double, little tinyint, big binary, done boolean"
FULL = ("u", 1, 2, 3, 4.0, 5.0, 6, bytearray(b"7"), True)
OTHER = ("v", 2, 3, 4, 5.0, 6.0, 7, bytearray(b"8"), False)


def test_base(spark):
    left, right = [("nulls", *[None] * 9), ("full", *FULL)], [("nulls", *[None] * 9), ("full", *FULL)]
    for i in range(9):
        for kind, x, y in (("d", FULL[i], OTHER[i]), ("l", FULL[i], None), ("r", None, FULL[i])):
            put = lambda v, i=i: tuple(v if j == i else FULL[j] for j in range(9))
            left.append((f"{kind}{i}", *put(x)))
            right.append((f"{kind}{i}", *put(y)))
    got = results(spark, rows(spark, BASE, left), rows(spark, BASE, right), KEY)[""]
    assert got["record"] == (2, 27, 0, 0, 0) and got["kind"] == (9, 9, 9, 0) and got["key"] == (29, 0, 0, 0)
    assert all(got[f] == (26, 1, 1, 1) for f in got if f not in ("record", "kind", "key"))


def test_one_sided_records_and_empty_inputs(spark):
    one = lambda k: rows(spark, "key string, value float", [(k, 1.0)])
    none = rows(spark, "key string, value float", [])
    assert results(spark, one("A"), one("B"), KEY)[""] == {"record": (0, 0, 1, 1, 0), "kind": (0, 0, 0, 0), "key": (0,) * 4, "value": (0,) * 4}
    assert results(spark, one("A"), none, KEY)[""]["record"] == (0, 0, 1, 0, 0)
    assert results(spark, none, none, KEY)[""] == {"record": (0,) * 5, "kind": (0,) * 4, "key": (0,) * 4, "value": (0,) * 4}


def test_absent_fields_are_null(spark):
    right = [("nulls", *[None] * 9)] + [(f"{i}", *[FULL[j] if j == i else None for j in range(9)]) for i in range(9)] + [("full", *FULL)]
    got = results(spark, rows(spark, "key string", [(r[0],) for r in right]), rows(spark, BASE, right), KEY)[""]
    assert got["record"] == (1, 10, 0, 0, 0) and got["kind"] == (0, 0, 10, 0) and got["user"] == (9, 2)


def test_null_and_empty_keys_differ(spark):
    data = [(None, 1), ("", 2), ("a", 3), ("b", 4)]
    assert results(spark, *[rows(spark, "key string, value int", data)] * 2, KEY)[""]["record"] == (4, 0, 0, 0, 0)


def test_null_parent_and_null_leaf_are_different_keys(spark):
    data = [(1, None), (2, (None, 1)), (3, ("a", 1)), (4, ("b", None)), (5, ("", 2))]
    got = results(spark, *[rows(spark, "value bigint, simple struct<key:string,value:int>", data)] * 2, {"keys": ["simple.key"]})[""]
    assert got["record"] == (5, 0, 0, 0, 0) and got["simple"] == (5, 0, 0, 0) and got["simple.key"] == (4, 0, 0, 0) and got["simple.value"] == (4, 0, 0, 0)


def test_time_types(spark):
    day = dt.date(2020, 1, 1)
    for kind, x, y in (("date", day, dt.date(2021, 1, 1)), ("timestamp", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)), ("timestamp_ntz", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2))):
        left = rows(spark, f"key string, date {kind}", [("a", x), ("b", x), ("c", x), ("d", None)])
        right = rows(spark, f"key string, date {kind}", [("a", x), ("b", y), ("c", None), ("d", x)])
        got = results(spark, left, right, KEY)[""]
        assert got["record"] == (1, 3, 0, 0, 0) and got["kind"] == (1, 1, 1, 0) and got["date"] == (1, 1, 1, 1)
    shown = diff(left, right, KEY).run().root.fields["date"].categories["different"].examples[0]
    assert (shown.left, shown.right) == ("2020-01-01 00:00:00", "2020-01-02 00:00:00")


def test_type_change(spark):
    left = rows(spark, "key string, count int", [("a", None), ("b", 1), ("c", 2), ("d", None)])
    right = rows(spark, "key string, count string", [("a", None), ("b", "1"), ("c", None), ("d", "3")])
    got = results(spark, left, right, KEY)[""]
    assert got["record"] == (1, 3, 0, 0, 0) and got["kind"] == (0, 1, 1, 1)
    assert got["count (int)"] == (2, 2) and got["count (string)"] == (2, 2)


def test_multiple_matches(spark):
    schema = "key string, count int"
    left = [("A", 1), ("A", 2), ("B", 1), ("D", 1), ("D", 1), ("E", 1), ("G", 1), ("G", 1)]
    right = [("B", 1), ("B", 2), ("C", 1), ("C", 2), ("E", 1), ("E", 1), ("F", 1), ("F", 1), ("G", 1)]
    got = results(spark, rows(spark, schema, left), rows(spark, schema, right), KEY)[""]
    assert got["record"] == (0, 0, 0, 0, 7) and got["count"] == (0, 0, 0, 0)
    omit = results(spark, rows(spark, schema, left), rows(spark, schema, right), KEY | {"multiple-matches": {"omit-if-all-identical": True}})[""]
    assert omit["record"] == (2, 0, 1, 1, 3)


def test_omit_uses_no_tolerance_and_no_ignored_field(spark):
    left = rows(spark, "key string, a int, b int", [("x", 1, 1), ("x", 2, 1), ("y", 1, 1), ("y", 1, 2)])
    right = rows(spark, "key string, a int, b int", [("x", 1, 1), ("y", 1, 1)])
    omit = KEY | {"multiple-matches": {"omit-if-all-identical": True}}
    assert results(spark, left, right, omit | {"default-tolerance": {"absolute": 5}})[""]["record"] == (0, 0, 0, 0, 2)
    assert results(spark, left, right, omit | {"ignore": {"fields": ["b"]}})[""]["record"] == (1, 0, 0, 0, 1)


def test_arrays_are_atomic_and_ordered(spark):
    pairs = [([1, 2], [1, 2]), (None, None), ([1, None], [1, None]), ([1, 2], [2, 1]), ([1], [1, None]), ([], [None]), ([1], None), (None, [])]
    schema = "key int, a array<int>"
    got = results(spark, rows(spark, schema, [(i, x) for i, (x, _) in enumerate(pairs)]), rows(spark, schema, [(i, y) for i, (_, y) in enumerate(pairs)]), KEY)[""]
    assert got["a"] == (3, 3, 1, 1) and got["kind"] == (3, 1, 1, 0)


def test_maps_are_not_ordered(spark):
    nan = float("nan")
    pairs = [({"a": 1.0, "b": None}, {"b": None, "a": 1.0}), ({"a": nan}, {"a": nan}), ({"a": 1.0}, {"b": 1.0}), ({"a": 1.0}, {"a": None}), ({}, {"a": 1.0}), ({"a": 1.0}, None), ({"a": 0.0}, {"a": -0.0})]
    schema = "key int, m map<string,double>"
    left, right = (rows(spark, schema, [(i, p[s]) for i, p in enumerate(pairs)]) for s in (0, 1))
    got = results(spark, left, right, KEY)[""]
    assert got["m"] == (3, 3, 1, 0)
    twice = results(spark, left.union(left), right, KEY | {"multiple-matches": {"omit-if-all-identical": True}})[""]
    assert twice["m"] == (3, 3, 1, 0)


def test_map_of_struct_and_map_in_map(spark):
    pairs = [({"a": ("u", {"x": 1, "y": 2})}, {"a": ("u", {"y": 2, "x": 1})}), ({"a": ("u", {"x": 1})}, {"a": ("u", {"x": 2})}), ({"a": None}, {"a": None})]
    schema = "key int, m map<string,struct<u:string,n:map<string,int>>>"
    got = results(spark, *(rows(spark, schema, [(i, p[s]) for i, p in enumerate(pairs)]) for s in (0, 1)), KEY)[""]
    assert got["m"] == (2, 1, 0, 0)


def test_nested_struct(spark):
    left = [("n", None), ("same", ("a", 1)), ("value", ("b", 2)), ("left", ("c", 3)), ("right", None)]
    right = [("n", None), ("same", ("a", 1, None)), ("value", ("b", 9, None)), ("left", None), ("right", ("d", 4, None))]
    narrow, wide = "key string, nested struct<name:string,value:int>", "key string, nested struct<name:string,value:int,second:bigint>"
    got = results(spark, rows(spark, narrow, left), rows(spark, wide, right), KEY)[""]
    assert got["record"] == (2, 3, 0, 0, 0) and got["kind"] == (1, 1, 1, 0) and got["nested"] == (2, 1, 1, 1)
    assert got["nested.name"] == (2, 0, 0, 0) and got["nested.value"] == (1, 1, 0, 0) and got["nested.second"] == (2, 0)
    right[1] = ("same", ("a", 1, 7))
    got = results(spark, rows(spark, narrow, left), rows(spark, wide, right), KEY)[""]
    assert got["kind"] == (1, 1, 2, 0) and got["nested"] == (1, 2, 1, 1) and got["nested.second"] == (1, 1)


def test_absent_struct_is_null_but_not_a_struct_of_nulls(spark):
    left = rows(spark, "key int", [(1,), (2,)])
    right = rows(spark, "key int, nested struct<name:string,value:int>", [(1, None), (2, (None, None))])
    got = results(spark, left, right, KEY)[""]
    assert got["record"] == (1, 1, 0, 0, 0) and got["nested"] == (1, 1) and got["nested.name"] == (0, 0)


ARRAYS = [
    ("both null", None, None), ("equal", [("a", 1), ("b", 2), None], [("a", 1), ("b", 2), None]), ("different", [("a", 3), ("b", 4)], [("a", 1024), ("b", 4)]),
    ("more left", [("a", 5), ("b", 6)], [("a", 5)]), ("more right", [("a", 7)], [("a", 7), ("b", 8)]), ("left", [("a", 9)], None), ("right", None, [("a", 10)]),
]
ARRAY = "key string, array array<struct<key:string,value:int>>"


def test_struct_arrays_by_position_and_by_key(spark):
    left, right = (rows(spark, ARRAY, [(a[0], a[s]) for a in ARRAYS]) for s in (1, 2))
    got = results(spark, left, right, KEY)[""]
    assert got["record"] == (2, 5, 0, 0, 0) and got["kind"] == (1, 2, 2, 0) and got["array"] == (2, 3, 1, 1)
    assert got["array (struct)"] == (6, 1, 1, 1) and got["array.key"] == (6, 0, 0, 0) and got["array.value"] == (5, 1, 0, 0)
    keyed = results(spark, left, right, KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}})
    assert keyed[""]["array"] == (2, 3, 1, 1) and keyed["array"] == {"record": (5, 1, 1, 1, 0), "kind": (1, 0, 0, 0), "key": (6, 0, 0, 0), "value": (5, 1, 0, 0)}


def test_absent_struct_arrays(spark):
    right = rows(spark, ARRAY, [("a", None), ("b", []), ("c", [None]), ("d", [("x", 1)]), ("e", [("x", 1), ("y", 2)])])
    left = right.select("key")
    got = results(spark, left, right, KEY)[""]
    assert got["array"] == (1, 4) and got["array (struct)"] == (0, 3) and got["array.key"] == (0, 0)
    assert results(spark, left, right, KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}})["array"] == {"record": (3,), "key": (0,), "value": (0,)}


def test_identical_arrays(spark):
    data = [("a", None), ("b", []), ("c", [None]), ("d", [("x", 1)]), ("e", [("x", 1), ("y", 2)])]
    same = [rows(spark, ARRAY, data)] * 2
    got = results(spark, *same, KEY)[""]
    assert got["array"] == (5, 0, 0, 0) and got["array (struct)"] == (4, 0, 0, 0) and got["array.key"] == (3, 0, 0, 0)
    assert results(spark, *same, KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}})["array"]["record"] == (3, 0, 0, 0, 0)


def test_keyed_arrays_ignore_order_and_count_nulls(spark):
    by_key = KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}}
    left = rows(spark, ARRAY, [("a", [("x", 1), None, ("y", 2)]), ("b", [None]), ("c", [])])
    right = rows(spark, ARRAY, [("a", [None, ("y", 2), ("x", 1)]), ("b", []), ("c", [None, None])])
    got = results(spark, left, right, by_key)
    assert got[""]["record"] == (1, 2, 0, 0, 0) and got[""]["kind"] == (2, 0, 0, 0) and got["array"]["record"] == (2, 0, 0, 0, 0)


def test_repeated_elements(spark):
    """Repeated keys make the record different without any kind; the root's policy does not reach arrays; arrays equal as a
    whole are identical however often keys repeat."""
    config = KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}}
    left = rows(spark, ARRAY, [("a", [("x", 1), ("x", 1)]), ("b", [("x", 1), ("x", 2)])])
    right = rows(spark, ARRAY, [("a", [("x", 1)]), ("b", [("x", 1), ("x", 2)])])
    for policy in ({}, {"multiple-matches": {"omit-if-all-identical": True}}):
        got = results(spark, left, right, config | policy)
        assert got[""]["record"] == (1, 1, 0, 0, 0) and got[""]["kind"] == (0, 0, 0, 0) and got["array"]["record"] == (2, 0, 0, 0, 1)
    own = KEY | {"exploded-arrays": {"array": {"keys": ["key"], "multiple-matches": {"omit-if-all-identical": True}}}}
    got = results(spark, left, right, own)
    assert got[""]["record"] == (2, 0, 0, 0, 0) and got[""]["array"] == (2, 0, 0, 0) and got["array"]["record"] == (3, 0, 0, 0, 0)


def test_keyed_in_keyed(spark):
    schema = "key string, array array<struct<key:string,int:int,nested_array:array<struct<nested_key:string,string:string>>>>"
    inner = lambda *ks: [(k, "s") for k in ks]
    left = rows(spark, schema, [("r", [("a", 1, inner("1")), ("b", 2, inner("1", "2")), ("c", 3, inner("1", "2", "3")), ("d", 4, inner("1", "2"))])])
    right = rows(spark, schema, [("r", [("d", 4, [("2", "s"), ("1", "t")]), ("c", 3, inner("3", "1")), ("b", 9, inner("2", "1")), ("a", 1, inner("1"))])])
    config = KEY | {"exploded-arrays": {"array": {"keys": ["key"]}, "array.nested_array": {"keys": ["nested_key"]}}}
    same = results(spark, left, left, config)
    assert same["array"]["record"] == (4, 0, 0, 0, 0) and same["array.nested_array"]["record"] == (8, 0, 0, 0, 0)
    got = results(spark, left, right, config)
    assert got["array"]["record"] == (1, 3, 0, 0, 0) and got["array"]["nested_array"] == (2, 2, 0, 0) and got["array"]["int"] == (3, 1, 0, 0)
    assert got["array.nested_array"]["record"] == (6, 1, 1, 0, 0)
    position = results(spark, left, right, KEY | {"exploded-arrays": {"array.nested_array": {"keys": ["nested_key"]}}})
    assert position[""]["array (struct)"] == (0, 4, 0, 0) and set(position) == {"", "array.nested_array"}


@pytest.mark.parametrize(
    ("tolerance", "right", "equal"),
    [({"absolute": 1}, (100, 101, 99, 102, 98), (1, 1, 1, 0, 0)), ({"relative": 0.1, "absolute": 0}, (95, 105, 91, 109, 89, 111), (1, 1, 1, 1, 0, 0)), ({"absolute": 10, "relative": 0.1}, (95, 105, 120, 80), (1, 1, 0, 0)), ({"absolute": 10, "relative": 0.04, "satisfies": "any"}, (91, 104, 120, 80), (1, 1, 0, 0))],
)
def test_tolerances_of_every_type_and_nesting(spark, tolerance, right, equal):
    for kind in ("smallint", "int", "bigint", "float", "double", "decimal(10,2)"):
        schema = f"key int, a {kind}, l array<{kind}>, m map<string,{kind}>, s struct<v:{kind}>"
        value = lambda v, kind=kind: __import__("decimal").Decimal(v) if "decimal" in kind else float(v) if kind in ("float", "double") else v
        row = lambda i, v: (i, value(v), [value(v), None], {"x": value(v)}, (value(v),))
        left, other = rows(spark, schema, [row(i, 100) for i in range(len(right))]), rows(spark, schema, [row(i, v) for i, v in enumerate(right)])
        got = counted(diff(left, other, KEY | {"default-tolerance": tolerance}).counts())[""]
        want = (sum(equal), len(right) - sum(equal), 0, 0)
        assert got["a"] == got["l"] == got["m"] == got["s.v"] == want, kind


def test_tolerance_inheritance_zero_nan_and_bytes(spark):
    schema = "key int, b tinyint, s struct<v:double,w:double>"
    left = rows(spark, schema, [(1, 1, (1.0, 1.0)), (2, 1, (0.0, float("nan"))), (3, 1, (float("inf"), float("inf")))])
    right = rows(spark, schema, [(1, 2, (1.5, 1.5)), (2, 1, (1.0, float("nan"))), (3, 1, (float("inf"), float("-inf")))])
    got = results(spark, left, right, KEY | {"default-tolerance": {"absolute": 1}, "tolerances": {"s.w": {"absolute": 0}}})[""]
    assert got["b"] == (2, 1, 0, 0) and got["s.v"] == (3, 0, 0, 0) and got["s.w"] == (1, 2, 0, 0)
    assert results(spark, left, right, KEY | {"tolerances": {"s": {"relative": 1e9}}})[""]["s.v"] == (2, 1, 0, 0)


def test_aliases_at_every_level(spark):
    left = rows(spark, "key string, count int, nested struct<key:string,count:int>, array array<struct<key:string,count:int>>", [("a", None, None, None), ("b", 1, ("x", 1), [("x", 1)]), ("c", 1, ("x", 1), [("x", 1)])])
    right = rows(spark, "key2 string, count2 int, nested2 struct<key2:string,count2:int>, array2 array<struct<key2:string,count2:int>>", [("a", None, None, None), ("b", 1, ("x", 1), [("x", 1)]), ("c", 2, ("x", 2), [("x", 2)])])
    names = {"key2": "key", "count2": "count", "nested2": "nested", "nested2.key2": "key", "nested2.count2": "count", "array2": "array", "array2.key2": "key", "array2.count2": "count"}
    got = results(spark, left, right, KEY | {"right-aliases": names, "exploded-arrays": {"array": {"keys": ["key"]}}})
    assert got[""]["record"] == (2, 1, 0, 0, 0) and got[""]["nested.count"] == (1, 1, 0, 0) and got["array"] == {"record": (1, 1, 0, 0, 0), "kind": (1, 0, 0, 0), "key": (2, 0, 0, 0), "count": (1, 1, 0, 0)}
    ignored = results(spark, left, right, KEY | {"right-aliases": names, "ignore": {"fields": ["count", "nested.count", "array"]}})
    assert ignored[""]["record"] == (3, 0, 0, 0, 0) and "count" not in ignored[""]


def test_only_keys(spark):
    schema = "key string, nested struct<key:string,count:int>, exploded_array array<struct<key:string,count:int>>, count int"
    left = [("a", ("a", 1), [("x", 1)], 1), ("b", ("b", 1), None, 1), ("c", ("c", 1), [("x", 1)], 1), ("d", None, [], 5)]
    right = [("a", ("a", 2), [("x", 2)], 2), ("b", ("b", 2), None, 2), ("c", ("c", 2), [("y", 1)], 1), ("e", None, [], 5)]
    config = {"keys": ["key", "nested.key"], "exploded-arrays": {"exploded_array": {"keys": ["key"]}}, "ignore": {"fields": ["count", "nested.count", "exploded_array.count"]}}
    got = results(spark, rows(spark, schema, left), rows(spark, schema, right), config)
    assert got[""]["record"] == (2, 1, 1, 1, 0) and got[""]["kind"] == (0, 0, 0, 1) and got[""]["nested.key"] == (3, 0, 0, 0)
    assert got["exploded_array"]["record"] == (1, 0, 1, 1, 0)


def test_negative_zero_meets_zero(spark):
    schema = "key double, e array<struct<k:double,v:int>>"
    left, right = rows(spark, schema, [(0.0, [(0.0, 1), (5.0, 1)])]), rows(spark, schema, [(-0.0, [(5.0, 1), (-0.0, 1)])])
    got = results(spark, left, right, KEY | {"exploded-arrays": {"e": {"keys": ["k"]}}})
    assert got[""]["record"] == (1, 0, 0, 0, 0) and got["e"]["record"] == (2, 0, 0, 0, 0)


def test_examples_are_capped_and_ordered_by_key(spark):
    left, right = rows(spark, "key int, v int", [(i, i) for i in range(9)]), rows(spark, "key int, v int", [(i, i + 1) for i in range(9)])
    out = diff(left, right, KEY | {"max-examples": 2}).run()
    shown = out.root.fields["v"].categories["different"]
    assert shown.count == 9 and [(e.key, e.left, e.right) for e in shown.examples] == [([{"key": 0}], 0, 1), ([{"key": 1}], 1, 2)]
    assert out.left_schema.simpleString() == "struct<key:int,v:int>"
    assert diff(left, right, KEY | {"max-examples": 0}).run().root.fields["v"].categories["different"].examples == []


def test_examples_of_repeated_rows_and_elements(spark):
    left = rows(spark, ARRAY, [("a", [("x", 1)]), ("a", None), ("b", [("x", 1), ("x", 2)])])
    right = rows(spark, ARRAY, [("a", None), ("b", [("x", 1)])])
    out = diff(left, right, KEY | {"exploded-arrays": {"array": {"keys": ["key"]}}}).run()
    (several,) = out.root.records["multiple_matches"].examples
    assert several.key == [{"key": "a"}] and len(several.left) == 2 and several.right == [{"key": "a", "array": None}]
    (elements,) = out.keyed_arrays["array"].records["multiple_matches"].examples
    assert elements.key == [{"key": "x"}, {"key": "b"}] and [e["value"] for e in elements.left] == [2, 1]


def test_pruned_entry_point(spark, tmp_path):
    left = rows(spark, "key int, a int, junk string, s struct<x:int,junk:string>", [(1, 1, "j", (1, "j")), (2, 2, "j", None)])
    right = rows(spark, "s struct<y:string,x:int>, a int, key int", [(("z", 1), 1, 1), (None, 3, 2)])
    config = KEY | {"ignore": {"left-only": True, "right-only": True}}
    left.write.parquet(str(tmp_path / "l"))
    right.write.json(str(tmp_path / "r"))
    made = diff_pruned(files(spark, str(tmp_path / "l")), files(spark, str(tmp_path / "r"), "json"), left.schema, right.schema, config)
    assert made.left.columns == ["key", "a", "s"] and made.left.schema["s"].dataType.simpleString() == "struct<x:int>"
    assert counted(made.counts()) == counted(diff(left, right, config).counts()) == counted(diff_pruned(frame(left), frame(right), left.schema, right.schema, config).counts())
    with pytest.raises(ConfigError):
        diff_pruned(lambda s: left, frame(right), left.schema, right.schema, config)


def test_input_formats(spark, tmp_path):
    left = rows(spark, "key string, value int", [("a", 1), ("b", 2)])
    left.write.option("header", True).csv(str(tmp_path / "csv"))
    left.write.json(str(tmp_path / "json"))
    schema = left.schema
    for kind in ("csv", "json"):
        made = diff_pruned(files(spark, str(tmp_path / kind), kind), frame(left), schema, schema, KEY)
        assert counted(made.counts())[""]["record"] == (2, 0, 0, 0, 0)


def test_stream_is_compared_batch_by_batch(spark, tmp_path):
    from driftframe.streaming import each_batch

    data = rows(spark, "key int, v int", [(1, 1), (2, 2)])
    data.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(each_batch(lambda n: data.filter("key = 1"), KEY, lambda c, n: seen.append(counted(c)))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert seen[0][""]["record"] == (1, 0, 1, 0, 0)
