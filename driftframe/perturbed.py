"""The driver's queries: each compares a table with a deterministic perturbation of itself.

Both sides are SQL text that Spark and other engines read alike. ``SPECS`` also say how the expected counts follow from a plain
full outer join, from which ``oracle.py`` writes the SQL that checks the engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from driftframe.api import diff, diff_pruned
from driftframe.config import DiffConfig
from driftframe.sources import frame


@dataclass
class F:
    """A reported field for the oracle. ``left``/``right``: expressions over a side's row (``x`` stands for its alias; none: the
    side lacks it); ``same``: when two values that are not null are equal (over ``l`` and ``r``); ``parent``: name of the
    enclosing struct; ``struct``: judged by its members; ``key``: not compared."""

    name: str
    left: str | None = None
    right: str | None = None
    same: str | None = None
    parent: str | None = None
    struct: bool = False
    key: bool = False


@dataclass
class Spec:
    left: str
    right: str
    config: dict[str, Any]
    keys: list[str]
    fields: list[F]
    omit: list[str] | None = None  # columns that must agree for repeated rows to be left out
    pruned: bool = False
    text: bool = False  # the configuration is read from text, written out and read again
    tables: tuple[str, ...] = ("orders",)
    where: str | None = None  # of the result


def both(name: str, column: str | None = None, same: str | None = None, parent: str | None = None, key: bool = False) -> F:
    c = f"x.{column or name}"
    return F(name, c, c, same, parent, key=key)


def _orders(side: str, columns: str = "", where: str = "") -> str:
    left = side == "left"
    key = "o_orderkey" if left else "CASE WHEN o_orderkey % 89 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END"
    price = "o_totalprice" if left else "CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1.0 ELSE o_totalprice END"
    customer = f"CASE WHEN o_orderkey % {29 if left else 31} = 0 THEN NULL ELSE o_custkey END"
    rest = "o_orderstatus AS status, o_orderdate AS day, o_orderpriority AS priority"
    kept = "" if left else " WHERE o_orderkey % 97 <> 0"
    return f"SELECT {columns or f'{key} AS k, {customer} AS cust, {price} AS price, {rest}'} FROM {{orders}}{kept or ' WHERE o_orderkey % 101 <> 0'}{where}"


_L, _R = _orders("left"), _orders("right")
_FLAT = [both("k", key=True), both("cust"), both("price"), both("status"), both("day"), both("priority")]


def _twice(sql: str, of: str = "k", by: int = 53) -> str:
    return f"SELECT * FROM ({sql}) a UNION ALL SELECT * FROM ({sql}) b WHERE {of} % {by} = 0"


def _near(column: str, absolute: float | None = None, relative: float | None = None, joined: str = "AND") -> str:
    x, y = f"CAST(l.{column} AS DOUBLE)", f"CAST(r.{column} AS DOUBLE)"
    tests = [f"abs({x} - {y}) <= {absolute}"] if absolute else []
    if relative:
        tests.append(f"(least(abs({x}), abs({y})) > 0 AND abs({x} - {y}) <= {relative} * 1e0 * least(abs({x}), abs({y})))")
    return f"(l.{column} = r.{column} OR ({f' {joined} '.join(tests)}))"


# Powers of two apart, so that no distance lies near a bound in one engine and beyond it in the other.
_STEP = "CASE WHEN {k} % 13 = 0 THEN {c} + 1.0 WHEN {k} % 17 = 0 THEN {c} + 64.0 WHEN {k} % 19 = 0 THEN {c} * 2.0 ELSE {c} END"
_PL = "SELECT p_partkey AS k, CAST(floor(p_retailprice) AS DOUBLE) AS price, p_size AS size FROM {part}"
_PR = f"SELECT p_partkey AS k, {_STEP.format(k='p_partkey', c='CAST(floor(p_retailprice) AS DOUBLE)')} AS price, CASE WHEN p_partkey % 11 = 0 THEN p_size + 3 ELSE p_size END AS size FROM {{part}}"


def _tolerance(config: dict[str, Any], price: str | None, size: str | None) -> Spec:
    return Spec(_PL, _PR, {"keys": ["k"]} | config, ["k"], [both("k", key=True), both("price", same=price), both("size", same=size)], tables=("part",))


_CL = "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE named_struct('nation', c_nationkey, 'balance', c_acctbal) END AS s FROM {customer}"
_CR = (
    "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE named_struct('nation', CASE WHEN c_custkey % 13 = 0 THEN c_nationkey + 1 ELSE c_nationkey END, "
    "'balance', c_acctbal, 'segment', CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE NULL END) END AS s FROM {customer} WHERE c_custkey % 97 <> 0"
)
_STRUCT = [both("k", key=True), both("name"), F("s", "x.s", "x.s", struct=True), both("s.nation", "s.nation", parent="s"), both("s.balance", "s.balance", parent="s"), F("s.segment", None, "x.s.segment", parent="s")]

SPECS: dict[str, Spec] = {
    "field_counts_common": Spec(_L, _R, {"keys": ["k"]}, ["k"], _FLAT),
    "record_counts": Spec(_L, _R, {"keys": ["k"]}, ["k"], _FLAT, where="field = '' AND kind = 'record'"),
    "kind_of_different": Spec(_L, _R, {"keys": ["k"]}, ["k"], _FLAT, where="kind = 'kind'"),
    "pruned_entry_point": Spec(_L, _R, {"keys": ["k"], "ignore": {"fields": ["day", "status"]}}, ["k"], [f for f in _FLAT if f.name not in ("day", "status")], pruned=True),
    "composite_key": Spec(_L, _R, {"keys": ["k", "status"]}, ["k", "status"], [both("k", key=True), both("status", key=True), both("cust"), both("price"), both("day"), both("priority")]),
    "null_key": Spec(
        "SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE NULL END AS b, c_acctbal AS balance FROM {customer}",
        "SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE NULL END AS b, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM {customer}",
        {"keys": ["a", "b"]}, ["a", "b"], [both("a", key=True), both("b", key=True), both("balance")], tables=("customer",)),
    "multiple_matches_natural": Spec(
        "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, l_quantity AS quantity, l_shipdate AS shipped FROM {lineitem}",
        "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS quantity, l_shipdate AS shipped FROM {lineitem} WHERE l_suppkey % 17 <> 0",
        {"keys": ["k", "n"]}, ["k", "n"], [both("k", key=True), both("n", key=True), both("part"), both("quantity"), both("shipped")], tables=("lineitem",)),
    "omit_all_identical": Spec(_twice(_L), _twice(_R, by=59), {"keys": ["k"], "multiple-matches": {"omit-if-all-identical": True}}, ["k"], _FLAT, omit=["cust", "price", "status", "day", "priority"]),
    "multiple_matches_kept": Spec(_twice(_L), _twice(_R, by=59), {"keys": ["k"]}, ["k"], _FLAT),
    "omit_strict_despite_tolerance": Spec(
        f"{_PL} UNION ALL SELECT p_partkey AS k, CAST(floor(p_retailprice) AS DOUBLE) + 0.5 AS price, p_size AS size FROM {{part}} WHERE p_partkey % 10 = 0", f"{_PR} UNION ALL SELECT * FROM ({_PR}) c WHERE k % 14 = 0",
        {"keys": ["k"], "default-tolerance": {"absolute": 1.5}, "multiple-matches": {"omit-if-all-identical": True}}, ["k"],
        [both("k", key=True), both("price", same=_near("price", 1.5)), both("size", same=_near("size", 1.5))], omit=["price", "size"], tables=("part",)),
    "omit_ignored_fields": Spec(
        f"{_PL} UNION ALL SELECT p_partkey AS k, CAST(floor(p_retailprice) AS DOUBLE) + 0.5 AS price, p_size AS size FROM {{part}} WHERE p_partkey % 10 = 0", _PR,
        {"keys": ["k"], "ignore": {"fields": ["price"]}, "multiple-matches": {"omit-if-all-identical": True}}, ["k"], [both("k", key=True), both("size")], omit=["size"], tables=("part",)),
    "tol_absolute": _tolerance({"default-tolerance": {"absolute": 1}}, _near("price", 1), _near("size", 1)),
    "tol_relative": _tolerance({"default-tolerance": {"relative": 0.25}}, _near("price", None, 0.25), _near("size", None, 0.25)),
    "tol_all": _tolerance({"default-tolerance": {"absolute": 10, "relative": 0.25}}, _near("price", 10, 0.25), _near("size", 10, 0.25)),
    "tol_any": _tolerance({"default-tolerance": {"absolute": 10, "relative": 0.25, "satisfies": "any"}}, _near("price", 10, 0.25, "OR"), _near("size", 10, 0.25, "OR")),
    "tol_per_field": _tolerance({"tolerances": {"price": {"absolute": 64}}}, _near("price", 64), None),
    "tol_disabled_by_zero": _tolerance({"default-tolerance": {"absolute": 64}, "tolerances": {"size": {"absolute": 0}}}, _near("price", 64), None),
    "tol_relative_zero": Spec(
        "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM {part}", "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM {part}",
        {"keys": ["k"], "default-tolerance": {"relative": 1000000000}}, ["k"], [both("k", key=True), both("price", same="(l.price = r.price OR (l.price <> 0 AND r.price <> 0))")], tables=("part",)),
    "nan_equality": Spec(
        "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS price FROM {part}", "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS price FROM {part}",
        {"keys": ["k"], "default-tolerance": {"absolute": 1}}, ["k"], [both("k", key=True), both("price", same="((isnan(l.price) AND isnan(r.price)) OR l.price = r.price)")], tables=("part",)),
    "ignore_fields": Spec(_L, _R, {"keys": ["k"], "ignore": {"fields": ["price", "day"]}}, ["k"], [f for f in _FLAT if f.name not in ("price", "day")]),
    "absent_as_null": Spec(_orders("left", "o_orderkey AS k, o_custkey AS cust"), _R, {"keys": ["k"]}, ["k"], [both("k", key=True), both("cust"), *(F(n, None, f"x.{n}") for n in ("price", "status", "day", "priority"))]),
    "ignore_left_only": Spec(_L, _orders("right", "o_orderkey AS k, o_custkey AS cust, o_orderdate AS date"), {"keys": ["k"], "ignore": {"left-only": True}}, ["k"], [both("k", key=True), both("cust"), F("date", None, "x.date")]),
    "ignore_right_only": Spec(_orders("left", "o_orderkey AS k, o_custkey AS cust, o_orderdate AS date"), _R, {"keys": ["k"], "ignore": {"right-only": True}}, ["k"], [both("k", key=True), both("cust"), F("date", "x.date", None)]),
    "alias_left": Spec(_orders("left", "o_orderkey, o_custkey, o_totalprice AS price"), _R, {"keys": ["k"], "left-aliases": {"o_orderkey": "k", "o_custkey": "cust"}}, ["k"],
        [F("k", "x.o_orderkey", "x.k", key=True), F("cust", "x.o_custkey", "x.cust"), both("price"), *(F(n, None, f"x.{n}") for n in ("status", "day", "priority"))]),
    "alias_both": Spec(_orders("left", "o_orderkey, o_custkey"), _orders("right", "o_orderkey AS kk, o_custkey AS cc"), {"keys": ["id"], "left-aliases": {"o_orderkey": "id", "o_custkey": "who"}, "right-aliases": {"kk": "id", "cc": "who"}}, ["id"],
        [F("id", "x.o_orderkey", "x.kk", key=True), F("who", "x.o_custkey", "x.cc")]),
    "alias_then_ignore": Spec(_orders("left", "o_orderkey, o_custkey, o_totalprice AS price"), _R, {"keys": ["k"], "left-aliases": {"o_orderkey": "k", "o_custkey": "cust"}, "ignore": {"fields": ["cust"], "right-only": True}}, ["k"],
        [F("k", "x.o_orderkey", "x.k", key=True), both("price")]),
    "type_change": Spec(_orders("left", "o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS cust"), _orders("right", "o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR(20)) END AS cust").replace("VARCHAR(20)", "{string}"), {"keys": ["k"]}, ["k"],
        [both("k", key=True), F("cust (bigint)", "x.cust", None), F("cust (string)", None, "x.cust")]),
    "struct_counts": Spec(_CL, _CR, {"keys": ["k"]}, ["k"], _STRUCT, tables=("customer",)),
    "struct_one_sided": Spec("SELECT c_custkey AS k FROM {customer}", _CR, {"keys": ["k"]}, ["k"], [both("k", key=True), F("name", None, "x.name"), F("s", None, "x.s"), *(F(n) for n in ("s.nation", "s.balance", "s.segment"))], tables=("customer",)),
    "array_atomic": Spec(
        "SELECT vec_id AS k, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding END AS v FROM {embeddings}", "SELECT vec_id AS k, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN slice(embedding, 1, 3) ELSE embedding END AS v FROM {embeddings}".replace("slice(embedding, 1, 3)", "{slice3}"),
        {"keys": ["k"]}, ["k"], [both("k", key=True), both("v")], tables=("embeddings",)),
    "byte_is_strict": Spec(
        "SELECT p_partkey AS k, CAST(p_size AS TINYINT) AS b, CAST(p_size AS SMALLINT) AS s FROM {part}", "SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS TINYINT) AS b, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS SMALLINT) AS s FROM {part}",
        {"keys": ["k"], "default-tolerance": {"absolute": 2}}, ["k"], [both("k", key=True), both("b"), both("s", same=_near("s", 2))], tables=("part",)),
    "binary_values": Spec(
        "SELECT p_partkey AS k, CAST(p_name AS {binary}) AS b FROM {part}", "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN CAST(concat(p_name, 'x') AS {binary}) ELSE CAST(p_name AS {binary}) END AS b FROM {part}",
        {"keys": ["k"]}, ["k"], [both("k", key=True), both("b")], tables=("part",)),
    "tol_nested": Spec(
        "SELECT c_custkey AS k, named_struct('nation', c_nationkey, 'balance', CAST(floor(c_acctbal) AS DOUBLE)) AS s FROM {customer}", "SELECT c_custkey AS k, named_struct('nation', CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END, 'balance', CASE WHEN c_custkey % 3 = 0 THEN floor(c_acctbal) + 1.0e0 WHEN c_custkey % 7 = 0 THEN floor(c_acctbal) + 64.0e0 ELSE floor(c_acctbal) + 0.0e0 END) AS s FROM {customer}",
        {"keys": ["k"], "default-tolerance": {"absolute": 100}, "tolerances": {"s": {"absolute": 2}, "s.nation": {"absolute": 0}}}, ["k"],
        [both("k", key=True), F("s", "x.s", "x.s", struct=True), both("s.nation", "s.nation", parent="s"), F("s.balance", "x.s.balance", "x.s.balance", "(abs(l.s.balance - r.s.balance) <= 2)", parent="s")], tables=("customer",)),
    "ignored_containers": Spec(_CL, _CR, {"keys": ["k"], "ignore": {"fields": ["s.nation", "s.balance", "s.segment"]}}, ["k"], [both("k", key=True), both("name")], tables=("customer",)),
    "demoted_container": Spec(_CL, _CR, {"keys": ["k"], "ignore": {"fields": ["s.nation", "s.balance"]}}, ["k"], [both("k", key=True), both("name"), F("s", None, "x.s"), F("s.segment")], tables=("customer",)),
    "configuration_text": Spec(_L, _R, {"keys": ["k"], "default-tolerance": {"absolute": 2}, "ignore": {"fields": ["day"]}}, ["k"], [both("k", key=True), both("cust", same="abs(l.cust - r.cust) <= 2"), both("price", same="abs(l.price - r.price) <= 2"), both("status"), both("priority")], text=True),
    "time_types": Spec(
        "SELECT event_id AS k, ts AS at, CAST(ts AS DATE) AS day FROM {events}", "SELECT event_id AS k, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ts + INTERVAL '1' DAY ELSE ts END AS at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM {events}",
        {"keys": ["k"]}, ["k"], [both("k", key=True), both("at"), both("day")], tables=("events",)),
    "field_counts_all_types": Spec(
        *(f"SELECT o_orderkey AS k, {', '.join(f'CASE WHEN o_orderkey % {p} = 0 THEN NULL ELSE CAST(o_orderkey % {m} AS {t}) END AS {n}' for n, t, p, m in (('a_byte', 'TINYINT', 7, 11), ('a_short', 'SMALLINT', 11, q), ('an_int', 'INT', 13, q), ('a_long', 'BIGINT', 17, q), ('a_float', 'FLOAT', 19, q), ('a_double', 'DOUBLE', 23, q), ('a_flag', 'BOOLEAN', p0, 2)))} FROM {{orders}}" for p0, q in ((3, 100), (5, 101))),
        {"keys": ["k"]}, ["k"], [both("k", key=True), *(both(n) for n in ("a_byte", "a_short", "an_int", "a_long", "a_float", "a_double", "a_flag"))]),
    "only_keys": Spec("SELECT r_regionkey AS k, r_name AS n FROM {region}", "SELECT r_regionkey + 1 AS k, r_name AS n FROM {region}", {"keys": ["k"], "ignore": {"fields": ["n"]}}, ["k"], [both("k", key=True)], tables=("region",)),
    "empty_right": Spec("SELECT n_nationkey AS k, n_name AS n FROM {nation}", "SELECT n_nationkey AS k, n_name AS n FROM {nation} WHERE n_nationkey < 0", {"keys": ["k"]}, ["k"], [both("k", key=True), both("n")], tables=("nation",)),
    "empty_both": Spec(*["SELECT n_nationkey AS k, n_name AS n FROM {nation} WHERE n_nationkey < 0"] * 2, {"keys": ["k"]}, ["k"], [both("k", key=True), both("n")], tables=("nation",)),
    "left_only_records": Spec("SELECT c_custkey AS k, c_name AS n FROM {customer}", "SELECT c_custkey AS k, c_name AS n FROM {customer} WHERE c_custkey % 97 <> 0", {"keys": ["k"]}, ["k"], [both("k", key=True), both("n")], tables=("customer",)),
    "right_only_records": Spec("SELECT c_custkey AS k, c_name AS n FROM {customer} WHERE c_custkey % 97 <> 0", "SELECT c_custkey AS k, c_name AS n FROM {customer}", {"keys": ["k"]}, ["k"], [both("k", key=True), both("n")], tables=("customer",)),
}


def side(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    for word, text in (("{string}", "STRING"), ("{binary}", "BINARY"), ("{slice3}", "slice(embedding, 1, 3)")):
        sql = sql.replace(word, text)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def runner(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = (side(spark, sf_dir, sql, spec.tables) for sql in (spec.left, spec.right))
        config = DiffConfig.from_json(DiffConfig.from_json(json.dumps(spec.config)).to_json()) if spec.text else spec.config
        made = diff_pruned(frame(left), frame(right), left.schema, right.schema, config) if spec.pruned else diff(left, right, config)
        return made.counts().filter(spec.where) if spec.where else made.counts()

    return run


