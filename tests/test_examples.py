import json

import pytest

from driftframe import durable
from driftframe.api import diff
from driftframe.config import ConfigError, DiffConfig
from driftframe.operators import examples


def test_repeated_rows_are_listed_up_to_a_bound_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(examples, "LISTED", 3)
    left = spark.createDataFrame([(1, i) for i in range(9)] + [(2, i) for i in range(3)], "k int, v int")
    right = spark.createDataFrame([(1, 0), (2, 5)], "k int, v int")
    got = {r["key"]: (json.loads(r["left"]), json.loads(r["right"])) for r in diff(left, right, {"keys": ["k"]}).examples().collect()}
    assert got['[{"k":1}]'] == ({"v": [{"k": 1, "v": 0}, {"k": 1, "v": 1}, {"k": 1, "v": 2}], "rows": 9}, {"v": [{"k": 1, "v": 0}]})
    assert got['[{"k":2}]'] == ({"v": [{"k": 2, "v": i} for i in range(3)]}, {"v": [{"k": 2, "v": 5}]})


def test_keyed_elements_whose_sides_differ_in_type(spark):
    left = spark.createDataFrame([(1, [(1, 5), (2, 6)])], "k int, a array<struct<i:int,x:int>>")
    right = spark.createDataFrame([(1, [(1, 5, "new"), (3, 7, None)])], "k int, a array<struct<i:int,x:int,z:string>>")
    config = {"keys": ["k"], "exploded-arrays": {"a": {"keys": ["i"]}}}
    for l, r, only in ((left, right, ("left_only", "right_only")), (right, left, ("right_only", "left_only"))):  # noqa: E741
        n = {(x["field"], x["category"]): x["n"] for x in diff(l, r, config).counts().filter("scope = 'a' and kind <> 'kind'").collect()}
        assert n["", "different"] == 1 and n["", only[0]] == 1 and n["", only[1]] == 1 and n["z", only[1]] == 1 and n["x", "identical"] == 1


def test_configuration_as_text_and_file(tmp_path):
    config = DiffConfig.from_dict({"keys": ["k", "s.i"], "tolerances": {"a.b": {"absolute": 0.5, "satisfies": "any"}}, "exploded-arrays": {"l": {"keys": ["x"]}}, "ignore": {"fields": ["z"], "left-only": True}})
    (tmp_path / "c.json").write_text(config.to_json())
    assert DiffConfig.from_json(config.to_json()) == DiffConfig.from_file(str(tmp_path / "c.json")) == config
    for text in ("keys: k", "[]", '{"keys": []}'):
        with pytest.raises(ConfigError):
            DiffConfig.from_json(text)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        durable.shared_dir(Session)
