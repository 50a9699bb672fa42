"""Frames and SQL that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import compatibility_table
from ..sources.tables import table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def forms_sql(text: str) -> str:
    """SQL of ``resolved_forms``."""
    source, target, several = compatibility_table()
    plain = f"translate({text}, {quoted(source)}, {quoted(target)})"
    pairs = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in several.items())
    spelled = f"array_to_string(list_transform(string_split({plain}, ''), lambda c: coalesce(map {{{pairs}}}[c], c)), '')"
    return f"case when regexp_matches({plain}, '[{''.join(several)}]') then {spelled} else {plain} end"


def terms_cte(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name(key, term)``, one row per occurrence."""
    return f"""
{name}_norm as (select {key}, lower({forms_sql(text)}) t from {source}),
{name}_runs as (select {key}, unnest(regexp_extract_all(t, '[a-z0-9]+(?:[-_./][a-z0-9]+)*|[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]+')) r from {name}_norm),
{name} as (
  select {key}, r term from {name}_runs where regexp_matches(r, '^[a-z0-9]') or length(r) = 1
  union all
  select {key}, p from (select {key}, unnest(string_split_regex(r, '[-_./]')) p from {name}_runs where regexp_matches(r, '^[a-z0-9]') and not regexp_full_match(r, '[a-z0-9]+')) where length(p) >= 2
  union all
  select {key}, substr(r, i, 2) from (select {key}, r, unnest(range(1, length(r))) i from {name}_runs where not regexp_matches(r, '^[a-z0-9]') and length(r) > 1))"""


TITLE = r"(?m)^#+[ \t]+([^\r\n]+)"


def title_of(text):
    """First heading of a text; empty where there is none."""
    return F.regexp_extract(text, TITLE, 1)


def principals(spark: SparkSession, folder: str) -> DataFrame:
    """One principal per group that collections name (it holds the group and ``all``),
    an administrator, and one without groups: ``principal, groups, admin``."""
    named = table(spark, folder, "collections").select(F.explode("effective_groups").alias("grp")).filter("grp is not null").distinct()
    users = named.select(F.concat(F.lit("user-"), F.col("grp")).alias("principal"), F.array_distinct(F.array(F.lit("all"), F.col("grp"))).alias("groups"), F.lit(False).alias("admin"))
    none = F.array().cast("array<string>")
    others = named.agg(F.count(F.lit(1))).select(F.explode(F.array(F.struct(F.lit("admin").alias("principal"), none.alias("groups"), F.lit(True).alias("admin")), F.struct(F.lit("nobody").alias("principal"), none.alias("groups"), F.lit(False).alias("admin")))).alias("p")).select("p.*")
    return users.unionByName(others)


PRINCIPALS = """
named as (select distinct unnest(effective_groups) grp from collections),
principals as (
  select 'user-' || grp principal, list_distinct(['all', grp]) groups, false admin from named where grp is not null
  union all select 'admin', []::varchar[], true union all select 'nobody', []::varchar[], false)"""


def readable_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, path, groups`` of documents by the groups of their collection; a
    document of an unknown collection is for administrators only."""
    groups = table(spark, folder, "collections").select(F.col("path").alias("collection"), F.col("effective_groups"))
    return table(spark, folder, "documents").select("doc_id", "collection").join(groups, "collection", "left").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("effective_groups", F.array().cast("array<string>")).alias("groups"))


READABLE = """
readable as (
  select d.doc_id, coalesce(c.effective_groups, []::varchar[]) groups
  from documents d left join collections c on c.path = d.collection),
access as (
  select distinct p.principal, r.doc_id from (select doc_id, unnest(groups) grp from readable) r
  join (select principal, unnest(groups) grp from principals where not admin) p using (grp)
  union
  select p.principal, r.doc_id from readable r, principals p where p.admin)"""

#: DuckDB: current rows of a versioned table.
def current_sql(name: str, key: str) -> str:
    return f"(select * from {name} where {key} is not null qualify row_number() over (partition by {key} order by ingested_at desc nulls last) = 1)"
