import pytest
from pyspark.sql import types as T

from driftframe.config import ConfigError, DiffConfig
from driftframe.plans.plan import build_plan


def plan(left, right, **config):
    of = T._parse_datatype_string if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL
    parse = T.StructType.fromDDL if hasattr(T.StructType, "fromDDL") else of
    return build_plan(parse(left), parse(right), DiffConfig.from_dict({"keys": ["k"]} | config))


def names(fields):
    return [(f.full, f.kind, names(f.children)) if f.children else (f.full, f.kind) for f in fields]


def test_fields_come_in_left_order_then_right(spark):
    p = plan("b int, k int, l int", "k int, r int, b int")
    assert names(p.fields) == [("b", "common"), ("k", "common"), ("l", "left"), ("r", "right")]
    assert p.read_schema("right").simpleString() == "struct<k:int,b:int,r:int>" or p.read_schema("right").simpleString() == "struct<b:int,k:int,r:int>"


def test_type_change_splits(spark):
    assert names(plan("k int, a int", "k int, a string").fields)[1:] == [("a (int)", "left"), ("a (string)", "right")]


def test_nullability_is_no_type_change(spark):
    left = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("a", T.ArrayType(T.IntegerType(), False))])
    right = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("a", T.ArrayType(T.IntegerType(), True))])
    assert names(build_plan(left, right, DiffConfig.from_dict({"keys": ["k"]})).fields) == [("k", "common"), ("a", "common")]


def test_containers_vanish_or_become_one_sided(spark):
    both = ("k int, s struct<a:int>, e array<struct<a:int>>", "k int, s struct<b:int>, e array<struct<b:int>>")
    assert names(plan(*both).fields)[1] == ("s", "common", [("s.a", "left"), ("s.b", "right")])
    assert names(plan(*both, ignore={"fields": ["s.b", "e.b"]}).fields)[1:] == [("s", "left", [("s.a", "left")]), ("e", "left", [("e.a", "left")])]
    assert names(plan(*both, ignore={"fields": ["s.a", "s.b", "e"]}).fields) == [("k", "common")]


def test_ignoring_one_sided_fields_leaves_type_changes(spark):
    p = plan("k int, a int, l int", "k int, a string, r int", ignore={"left-only": True, "right-only": True})
    assert names(p.fields)[1:] == [("a (int)", "left"), ("a (string)", "right")]


@pytest.mark.parametrize(
    ("left", "right", "config"),
    [("a int", "a int", {}), ("k int", "k string", {}), ("k int", "a int", {}), ("k array<int>", "k array<int>", {}), ("k int, e array<struct<i:int,v:int>>", "k int, e array<struct<i:int,v:int>>", {"exploded-arrays": {"e": {"keys": ["x"]}}}),
     ("k int, e array<struct<i:int,v:int>>", "k int, e array<struct<i:int,v:int>>", {"exploded-arrays": {"e": {"keys": ["i"]}}, "ignore": {"fields": ["e.i"]}}), ("k int, a int, b int", "k int, x int", {"left-aliases": {"a": "x", "b": "x"}}),
     ("e array<struct<k:int>>", "e array<struct<k:int>>", {"keys": ["e.k"]})],
)
def test_rejected(spark, left, right, config):
    with pytest.raises(ConfigError):
        plan(left, right, **config)


def test_vanished_array_needs_no_keys(spark):
    p = plan("k int, e array<struct<i:int>>", "k int, e array<struct<i:int>>", **{"exploded-arrays": {"e": {"keys": ["i"]}}, "ignore": {"fields": ["e"]}})
    assert names(p.fields) == [("k", "common")]
