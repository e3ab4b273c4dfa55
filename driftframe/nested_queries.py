"""Queries over nested data: maps, arrays of structs by position and by key, nested keys, examples, with SQL that works on the
rows un-nested (an element's key is a join key), so that it shares nothing with the engine's in-row matching."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.api import diff

# --- conversations: one row a conversation, an array of turns; elements are changed before they are nested ---

_KEPT = {"left": "(conv_id * 7 + turn) % 11 <> 0", "right": "(conv_id * 5 + turn) % 13 <> 0"}
_TEXT = {"left": "CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE text END", "right": "CASE WHEN (conv_id + turn) % 7 = 0 THEN concat(text, '!') ELSE text END"}
_NO_ARRAY = {"left": "conv_id % 17 = 0", "right": "conv_id % 19 = 0"}
_NO_CONVERSATION = {"left": "conv_id % 23 <> 0", "right": "conv_id % 29 <> 0"}


def _turns(side: str, repeat: bool = False) -> str:
    one = f"SELECT conv_id, turn, role, {_TEXT[side]} AS text FROM conversations WHERE {_KEPT[side]} AND {_NO_CONVERSATION[side]}"
    return f"{one} UNION ALL SELECT * FROM ({one}) t WHERE (conv_id + turn) % {8 if side == 'left' else 10} = 0" if repeat else one


def _conversations(spark: SparkSession, sf_dir: str, side: str, repeat: bool = False) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    everyone = spark.sql(f"SELECT DISTINCT conv_id FROM conversations WHERE {_NO_CONVERSATION[side]}")
    nested = spark.sql(_turns(side, repeat)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    return everyone.join(nested, "conv_id", "left").select("conv_id", F.when(F.expr(_NO_ARRAY[side]), None).otherwise(F.coalesce("turns", empty)).alias("turns"))


def _compare(config: dict[str, Any], repeat: bool = False, where: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = (_conversations(spark, sf_dir, s, repeat) for s in ("left", "right"))
        out = diff(left, right, {"keys": ["conv_id"]} | config).counts()
        return out.filter(where) if where else out

    return run


_BY_TURN = {"exploded-arrays": {"turns": {"keys": ["turn"]}}}
_BY_TURN_OMIT = {"exploded-arrays": {"turns": {"keys": ["turn"], "multiple-matches": {"omit-if-all-identical": True}}}}


def _status(x: str, y: str, same: str) -> str:
    return f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN 1 WHEN {x} IS NULL THEN 8 WHEN {y} IS NULL THEN 4 WHEN {same} THEN 1 ELSE 2 END"


def _conversation_sql(keyed: bool, repeat: bool = False, omit: bool = False) -> str:
    """Elements of conversations that are pairs with an array on both sides, joined on the element's key or position."""
    element = "turn" if keyed else "i"
    numbered = lambda s: f"SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text NULLS FIRST) - 1 AS i FROM ({_turns(s, repeat)}) q"
    many = f"CASE WHEN count(*) > 1 THEN {'CASE WHEN count(DISTINCT hash(role, text)) = 1 THEN 0 ELSE 1 END' if omit else '1'} ELSE 0 END"
    ctes = []
    for s in ("left", "right"):
        ctes.append(f"{s}_c AS (SELECT DISTINCT conv_id, {_NO_ARRAY[s]} AS none FROM conversations WHERE {_NO_CONVERSATION[s]})")
        ctes.append(f"{s}_t AS ({numbered(s)})")
        ctes.append(f"{s}_e AS (SELECT conv_id, {element} AS e, {many if keyed else '0'} AS many, min(turn) AS turn, min(role) AS role, min(text) AS text FROM {s}_t GROUP BY conv_id, {element})")
        # keys of arrays that are equal as a whole are pairs, repeated or not
        ctes.append(f"{s}_a AS (SELECT conv_id, string_agg(concat_ws('|', turn, role, coalesce(text, '<null>')), '|' ORDER BY i) AS a FROM {s}_t GROUP BY conv_id)")
    ctes.append("c AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, l.conv_id IS NOT NULL AS hl, r.conv_id IS NOT NULL AS hr, l.none AS nl, r.none AS nr, coalesce(la.a, '') = coalesce(ra.a, '') AS whole "
                "FROM left_c l FULL OUTER JOIN right_c r ON l.conv_id = r.conv_id LEFT JOIN left_a la ON la.conv_id = l.conv_id LEFT JOIN right_a ra ON ra.conv_id = r.conv_id)")  # fmt: skip
    ctes.append("p AS (SELECT * FROM c WHERE hl AND hr AND NOT nl AND NOT nr)")
    inner = [f"SELECT e.*, p.whole FROM {s}_e e JOIN p ON p.conv_id = e.conv_id" for s in ("left", "right")]
    text, role, turn = (_status(f"l.{c}", f"r.{c}", f"l.{c} = r.{c}") for c in ("text", "role", "turn"))
    flags = f"({text}) | ({role})" + ("" if keyed else f" | ({turn})")
    ctes.append(f"m AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, CASE WHEN NOT coalesce(l.whole, r.whole) AND coalesce(l.many, 0) + coalesce(r.many, 0) > 0 THEN 16 WHEN r.e IS NULL THEN 4 WHEN l.e IS NULL THEN 8 ELSE 0 END AS c, {flags} AS f, {text} AS s_text, {role} AS s_role, {turn} AS s_turn "
                f"FROM ({inner[0]}) l FULL OUTER JOIN ({inner[1]}) r ON l.conv_id = r.conv_id AND l.e = r.e)")  # fmt: skip
    if keyed:  # pairs of equal arrays count each element
        ctes.append("w AS (SELECT t.* FROM left_t t JOIN p ON p.conv_id = t.conv_id WHERE p.whole)")
        ctes.append("el AS (SELECT conv_id, c, CASE WHEN c = 0 THEN f ELSE c END AS f, s_text, s_role, s_turn FROM m WHERE conv_id NOT IN (SELECT conv_id FROM w) UNION ALL SELECT conv_id, 0, 1, 1, 1, 1 FROM w)")
    else:
        ctes.append("el AS (SELECT conv_id, c, CASE WHEN c = 0 THEN f ELSE c END AS f, s_text, s_role, s_turn FROM m)")
    ctes.append(f"af AS (SELECT p.conv_id, {'1 | ' if keyed else ''}coalesce(bit_or(el.f), {1 if keyed else 0}) AS f FROM p LEFT JOIN el ON el.conv_id = p.conv_id GROUP BY p.conv_id)")
    ctes.append("r AS (SELECT c.conv_id, CASE WHEN NOT hr THEN 4 WHEN NOT hl THEN 8 ELSE 0 END AS c, CASE WHEN hl AND hr THEN CASE WHEN nl AND nr THEN 1 WHEN nl THEN 8 WHEN nr THEN 4 WHEN (af.f | 1) = 1 THEN 1 ELSE 2 END END AS s, "
                "CASE WHEN hl AND hr THEN CASE WHEN nl AND nr THEN 1 WHEN nl THEN 8 WHEN nr THEN 4 ELSE af.f END END AS f FROM c LEFT JOIN af ON af.conv_id = c.conv_id)")  # fmt: skip
    rows = []

    def add(scope: str, field: str, kind: str, category: str, test: str, source: str) -> None:
        rows.append(f"SELECT '{scope}' AS scope, '{field}' AS field, '{kind}' AS kind, '{category}' AS category, CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS n FROM {source}")

    def records(scope: str, source: str) -> None:
        for category, test in (("identical", "c = 0 AND (f | 1) = 1"), ("different", "c = 0 AND (f | 1) <> 1"), ("left_only", "c = 4"), ("right_only", "c = 8"), ("multiple_matches", "c = 16")):
            add(scope, "", "record", category, test, source)
        for category, test in (("content", "(f & 2) = 2"), ("left_only", "(f & 14) = 4"), ("right_only", "(f & 14) = 8"), ("left_and_right_only", "(f & 14) = 12")):
            add(scope, "", "kind", category, f"c = 0 AND (f | 1) <> 1 AND {test}", source)

    def field(scope: str, name: str, status: str, source: str) -> None:
        for category, code in (("identical", 1), ("different", 2), ("left_only", 4), ("right_only", 8)):
            add(scope, name, "common", category, f"c = 0 AND {status} = {code}", source)

    records("", "r")
    field("", "conv_id", "1", "r")
    field("", "turns", "s", "r")
    scope, prefix = ("turns", "") if keyed else ("", "turns.")
    if keyed:
        records("turns", "el")
    else:
        for category, test in (("identical", "c = 0 AND (f | 1) = 1"), ("different", "c = 0 AND (f | 1) <> 1"), ("left_only", "c = 4"), ("right_only", "c = 8")):
            add("", "turns (struct)", "common", category, test, "el")
    for name in ("turn", "role", "text"):
        field(scope, prefix + name, f"s_{name}" if name != "turn" or not keyed else "1", "el")
    return f"WITH {', '.join(ctes)} SELECT * FROM ({' UNION ALL '.join(rows)}) o"


# --- keyed arrays in keyed arrays: customers' nations ---


def _regions(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Regions, each with an array of nations, each with an array of customers."""
    odd, bump = (5, 0) if side == "left" else (7, 1)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(f"c_custkey % {odd} <> 0")
    c = c.select("c_nationkey", F.struct("c_custkey", F.expr(f"CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || repeat('x', {bump}) ELSE c_mktsegment END AS segment")).alias("c"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list("c").alias("customers")), "n_nationkey", "left")
    n = n.filter("n_nationkey % 6 <> 5" if side == "left" else "n_nationkey % 8 <> 3")
    return n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "customers")).alias("nations"))


def exploded_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"keys": ["n_regionkey"], "exploded-arrays": {"nations": {"keys": ["n_nationkey"]}, "nations.customers": {"keys": ["c_custkey"]}}}
    return diff(_regions(spark, sf_dir, "left"), _regions(spark, sf_dir, "right"), config).counts().filter("scope = 'nations.customers' AND field <> '' OR scope = 'nations' AND kind = 'record'")


_NESTED_SQL = """
WITH l AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 5), r AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 8 <> 3),
lc AS (SELECT c_nationkey AS n, c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 5 <> 0),
rc AS (SELECT c_nationkey AS n, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || 'x' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 7 <> 0),
both_n AS (SELECT n_nationkey AS n FROM l JOIN r USING (n_nationkey)),
e AS (SELECT coalesce(a.n, b.n) AS n, CASE WHEN b.k IS NULL THEN 4 WHEN a.k IS NULL THEN 8 WHEN a.s = b.s THEN 1 ELSE 2 END AS c
  FROM (SELECT * FROM lc WHERE n IN (SELECT n FROM both_n)) a FULL OUTER JOIN (SELECT * FROM rc WHERE n IN (SELECT n FROM both_n)) b ON a.k = b.k),
nf AS (SELECT b.n, coalesce(bit_or(e.c), 1) AS f FROM both_n b LEFT JOIN e ON e.n = b.n GROUP BY b.n),
shared AS (SELECT DISTINCT n_regionkey FROM nation JOIN l USING (n_nationkey) INTERSECT SELECT DISTINCT n_regionkey FROM nation JOIN r USING (n_nationkey)),
nr AS (SELECT CASE WHEN r.n_nationkey IS NULL THEN 4 WHEN l.n_nationkey IS NULL THEN 8 WHEN (nf.f | 1) = 1 THEN 1 ELSE 2 END AS c
  FROM nation n LEFT JOIN l USING (n_nationkey) LEFT JOIN r USING (n_nationkey) LEFT JOIN nf ON nf.n = n.n_nationkey
  WHERE n.n_regionkey IN (SELECT n_regionkey FROM shared) AND (l.n_nationkey IS NOT NULL OR r.n_nationkey IS NOT NULL))
SELECT 'nations' AS scope, '' AS field, 'record' AS kind, x.category, CAST((SELECT count(*) FROM nr WHERE c = x.code) AS BIGINT) AS n
FROM (VALUES ('identical', 1), ('different', 2), ('left_only', 4), ('right_only', 8), ('multiple_matches', 16)) x(category, code)
UNION ALL
SELECT 'nations.customers', 'c_custkey', 'common', x.category, CAST((SELECT count(*) FROM e WHERE c IN (1, 2) AND x.code = 1) AS BIGINT)
FROM (VALUES ('identical', 1), ('different', 2), ('left_only', 4), ('right_only', 8)) x(category, code)
UNION ALL
SELECT 'nations.customers', 'segment', 'common', x.category, CAST((SELECT count(*) FROM e WHERE c = x.code AND x.code < 4) AS BIGINT)
FROM (VALUES ('identical', 1), ('different', 2), ('left_only', 4), ('right_only', 8)) x(category, code)
"""

# --- maps, nested keys, one-sided arrays, examples ---

_MAP = "SELECT o_orderkey AS k, map('status', {status}, 'day', {day}, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '{extra}' END, 'v') AS m, map({order}) AS p FROM {{orders}}"


def map_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = spark.sql(_MAP.format(status="o_orderstatus", day="CAST(o_orderdate AS STRING)", extra="y", order="'a', o_custkey, 'b', o_orderkey"), orders=orders)
    right = spark.sql(_MAP.format(status="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END", day="CAST(o_orderdate AS STRING)", extra="z", order="'b', o_orderkey, 'a', CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 2 ELSE o_custkey END"), orders=orders)
    return diff(left, right, {"keys": ["k"]}).counts()


def map_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = spark.sql("SELECT o_orderkey AS k, map('a', o_custkey, 'b', o_orderkey) AS p FROM {orders}", orders=orders)
    right = spark.sql("SELECT o_orderkey AS k, map('b', o_orderkey + o_orderkey % 5, 'a', o_custkey) AS p FROM {orders}", orders=orders)
    return diff(left, right, {"keys": ["k"], "tolerances": {"p": {"absolute": 2}}}).counts().filter("field = 'p'")


def array_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = spark.sql("SELECT o_orderkey AS k, array(o_custkey, NULL, o_orderkey) AS a FROM {orders}", orders=orders)
    right = spark.sql("SELECT o_orderkey AS k, array(o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 1 END, o_orderkey + o_orderkey % 5) AS a FROM {orders}", orders=orders)
    return diff(left, right, {"keys": ["k"], "default-tolerance": {"absolute": 2}}).counts().filter("field = 'a'")


def nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sql = "SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE named_struct('id', CASE WHEN c_custkey = 2 THEN NULL ELSE c_custkey END, 'name', {name}) END AS who, c_acctbal AS balance FROM {{customer}}"
    left = spark.sql(sql.format(name="c_name"), customer=customer)
    right = spark.sql(sql.format(name="CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE lower(c_name) END"), customer=customer)
    return diff(left, right, {"keys": ["who.id"]}).counts()


def struct_array_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _conversations(spark, sf_dir, "left").select("conv_id")
    right = _conversations(spark, sf_dir, "right")
    return diff(left, right, {"keys": ["conv_id"]}).counts()


def exploded_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _conversations(spark, sf_dir, "left").select("conv_id")
    right = _conversations(spark, sf_dir, "right")
    return diff(left, right, {"keys": ["conv_id"]} | _BY_TURN).counts()


def examples_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = spark.sql("SELECT o_orderkey AS k, o_custkey AS cust FROM {orders} WHERE o_orderkey % 97 <> 0", orders=orders)
    right = spark.sql("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS cust FROM {orders} WHERE o_orderkey % 89 <> 0", orders=orders)
    return diff(left, right, {"keys": ["k"], "max-examples": 20}).examples()


_EXAMPLES_SQL = """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS cust FROM orders WHERE o_orderkey % 97 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS cust FROM orders WHERE o_orderkey % 89 <> 0),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS lk, b.k AS rk, a.cust AS lc, b.cust AS rc FROM a FULL OUTER JOIN b ON a.k = b.k),
s AS (SELECT '[{"k":' || k || '}]' AS key, CASE WHEN rk IS NULL THEN 'left_only' WHEN lk IS NULL THEN 'right_only' WHEN lc <> rc THEN 'different' END AS category, * FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key) AS nth FROM s WHERE category IS NOT NULL)
SELECT '' AS scope, '' AS field, category, key, CASE WHEN lk IS NOT NULL THEN '{"v":{"k":' || lk || ',"cust":' || lc || '}}' END AS left, CASE WHEN rk IS NOT NULL THEN '{"v":{"k":' || rk || ',"cust":' || rc || '}}' END AS right
FROM n WHERE nth <= 20
UNION ALL SELECT '', 'cust', category, key, '{"v":' || lc || '}', '{"v":' || rc || '}' FROM n WHERE nth <= 20 AND category = 'different'
"""


def _simple(field: str, source: str) -> str:
    return f"SELECT '' AS scope, '{field}' AS field, 'common' AS kind, x.category, CAST(count(*) FILTER (WHERE s = x.code) AS BIGINT) AS n FROM ({source}) q, (VALUES ('identical', 1), ('different', 2), ('left_only', 4), ('right_only', 8)) x(category, code) GROUP BY x.category"


def _whole(fields: dict[str, str], table: str, key: str) -> str:
    """All counts of flat records that meet, from each field's test of equality."""
    same = " AND ".join(f"({t})" for t in fields.values())
    tests = [("", "record", {"identical": same, "different": f"NOT ({same})"}, ("identical", "different", "left_only", "right_only", "multiple_matches")), ("", "kind", {"content": f"NOT ({same})"}, ("content", "left_only", "right_only", "left_and_right_only"))]
    tests += [(f, "common", {"identical": t, "different": f"NOT ({t})"}, ("identical", "different", "left_only", "right_only")) for f, t in ({key: "true"} | fields).items()]
    return " UNION ALL ".join(f"SELECT '' AS scope, '{f}' AS field, '{kind}' AS kind, '{c}' AS category, CAST(count(*) FILTER (WHERE {when.get(c, 'false')}) AS BIGINT) AS n FROM {table}" for f, kind, when, categories in tests for c in categories)


_ONE_SIDED = f"SELECT r.conv_id, {_NO_ARRAY['right']} AS none FROM (SELECT DISTINCT conv_id FROM conversations WHERE {_NO_CONVERSATION['right']} AND {_NO_CONVERSATION['left']}) r"
_ONE_SIDED_TURNS = f"SELECT count(*) FROM ({_turns('right')}) t WHERE {_NO_CONVERSATION['left']} AND NOT ({_NO_ARRAY['right']})"

_LONE_CONVERSATIONS = {s: f"SELECT count(DISTINCT conv_id) FROM conversations WHERE {_NO_CONVERSATION[s]} AND NOT ({_NO_CONVERSATION[o]})" for s, o in (("left", "right"), ("right", "left"))}
#: All counts of the root of conversations of which only the right side has turns.
_ONE_SIDED_ROOT = f"""
SELECT '' AS scope, x.f AS field, x.k AS kind, x.c AS category, CAST(CASE x.w WHEN 'pairs' THEN (SELECT count(*) FROM p) WHEN 'nulls' THEN (SELECT count(*) FROM p WHERE none) WHEN 'arrays' THEN (SELECT count(*) FROM p WHERE NOT none) WHEN 'left' THEN ({_LONE_CONVERSATIONS["left"]}) WHEN 'right' THEN ({_LONE_CONVERSATIONS["right"]}) ELSE 0 END AS BIGINT) AS n
FROM (VALUES ('', 'record', 'identical', 'nulls'), ('', 'record', 'different', 'arrays'), ('', 'record', 'left_only', 'left'), ('', 'record', 'right_only', 'right'), ('', 'record', 'multiple_matches', ''),
  ('', 'kind', 'content', ''), ('', 'kind', 'left_only', ''), ('', 'kind', 'right_only', 'arrays'), ('', 'kind', 'left_and_right_only', ''),
  ('conv_id', 'common', 'identical', 'pairs'), ('conv_id', 'common', 'different', ''), ('conv_id', 'common', 'left_only', ''), ('conv_id', 'common', 'right_only', ''), ('turns', 'right', 'nulls', 'nulls'), ('turns', 'right', 'right_only', 'arrays')) x(f, k, c, w)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "struct_array_positional": _compare({}),
    "exploded_records": _compare(_BY_TURN),
    "exploded_duplicates": _compare(_BY_TURN, repeat=True),
    "exploded_duplicates_omitted": _compare(_BY_TURN_OMIT, repeat=True),
    "root_kind_from_array_flags": _compare({}, where="kind = 'kind'"),
    "exploded_nested": exploded_nested,
    "map_equality": map_equality,
    "map_tolerance": map_tolerance,
    "array_tolerance": array_tolerance,
    "nested_key": nested_key,
    "struct_array_one_sided": struct_array_one_sided,
    "exploded_one_sided": exploded_one_sided,
    "examples_capped": examples_capped,
}

SQL: dict[str, str] = {
    "struct_array_positional": _conversation_sql(False),
    "exploded_records": _conversation_sql(True),
    "exploded_duplicates": _conversation_sql(True, True),
    "exploded_duplicates_omitted": _conversation_sql(True, True, True),
    "root_kind_from_array_flags": f"SELECT * FROM ({_conversation_sql(False)}) w WHERE kind = 'kind'",
    "exploded_nested": _NESTED_SQL,
    "map_equality": _whole({"m": "o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0", "p": "o_orderkey % 11 <> 0"}, "orders", "k"),
    "map_tolerance": _simple("p", "SELECT CASE WHEN o_orderkey % 5 <= 2 THEN 1 ELSE 2 END AS s FROM orders"),
    "array_tolerance": _simple("a", "SELECT CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <= 2 THEN 1 ELSE 2 END AS s FROM orders"),
    "nested_key": f"""
WITH n AS (SELECT CAST(count(*) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE c_custkey = 1 OR lower(c_name) = c_name) AS BIGINT) AS same FROM customer)
SELECT '' AS scope, f AS field, k AS kind, c AS category, CASE w WHEN 'all' THEN a WHEN 'inner' THEN a - 1 WHEN 'same' THEN same WHEN 'diff' THEN a - same WHEN 'same_inner' THEN same - 1 ELSE 0 END AS n
FROM n, (VALUES ('', 'record', 'identical', 'same'), ('', 'record', 'different', 'diff'), ('', 'record', 'left_only', ''), ('', 'record', 'right_only', ''), ('', 'record', 'multiple_matches', ''),
  ('', 'kind', 'content', 'diff'), ('', 'kind', 'left_only', ''), ('', 'kind', 'right_only', ''), ('', 'kind', 'left_and_right_only', ''),
  {", ".join(f"('{f}', 'common', '{c}', '{w}')" for f, same, different in (("who", "same", "diff"), ("who.id", "inner", ""), ("who.name", "same_inner", "diff"), ("balance", "all", "")) for c, w in (("identical", same), ("different", different), ("left_only", ""), ("right_only", "")))}) x(f, k, c, w)""",
    "struct_array_one_sided": f"""
WITH p AS ({_ONE_SIDED}) {_ONE_SIDED_ROOT}
UNION ALL SELECT '' AS scope, x.f, 'right', x.c, CAST(CASE x.w WHEN 'turns' THEN ({_ONE_SIDED_TURNS}) ELSE 0 END AS BIGINT)
FROM (VALUES ('turns (struct)', 'nulls', ''), ('turns (struct)', 'right_only', 'turns'), ('turns.turn', 'nulls', ''), ('turns.turn', 'right_only', ''), ('turns.role', 'nulls', ''), ('turns.role', 'right_only', ''),
  ('turns.text', 'nulls', ''), ('turns.text', 'right_only', '')) x(f, c, w)""",
    "exploded_one_sided": f"""
WITH p AS ({_ONE_SIDED}) {_ONE_SIDED_ROOT}
UNION ALL SELECT 'turns', f, 'right', 'right_only', CAST(CASE WHEN f = '' THEN ({_ONE_SIDED_TURNS}) ELSE 0 END AS BIGINT) FROM (VALUES (''), ('turn'), ('role'), ('text')) x(f)""",
    "examples_capped": _EXAMPLES_SQL,
}
