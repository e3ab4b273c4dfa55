"""The queries of the ten operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftframe.llm import ann, decontaminate, html_extract, langid, license_scan, mixing, near_dedup, quality, secret_scan, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), digest=True)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(_table(spark, sf_dir, "documents")).drop("text_key")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_html_extract": op7_html_extract,
    "op8_nearest": op8_nearest,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op4_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (
  select distinct item_id, least(8, len(w)) as k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select r, i, dw.k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
hi as (select r, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct r, cast(item_id as varchar) as s from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hw using (r) left join hi using (r)
""",
    "op5_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, array_to_string(w[i:i + 34], ' ') as g from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select r, i from (select r, i, count(*) over (partition by g) as c from win) where c > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from rep),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select r, string_agg(x, ' ' order by p) as t from word anti join gone using (r, p) group by r),
cut as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r) left join cut using (r)
""",
    "op6_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from sh x join sh y on x.g = y.g and x.doc_id <> y.doc_id
  join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.b as component_id, d.doc_id = c.b as kept
from d left join n using (doc_id) join (select a, min(b) as b from reach group by a) c on c.a = d.doc_id
""",
}
