"""Queries on permissions, collections and who reads what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access
from ..operators.users import import_plan
from ..sources.tables import current_rows, table
from .common import PRINCIPALS, current_sql, principals


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "collections").select("path", "declared_groups", F.lit(False).alias("broken"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = current_rows(table(spark, folder, "docs").select("path", "collection", "declared_groups", "ingested_at"), "path")
    return docs.select("path", F.coalesce("collection", F.lit("")).alias("directory"), "declared_groups")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    return access.document_groups(documents, access.effective_groups(documents, _settings(spark, folder)))


def acl_directories(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of every directory in use and the directory that rules it."""
    found = access.effective_groups(_documents(spark, folder), _settings(spark, folder))
    return found.select("directory", "groups", "governed_by")


def acl_effective(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of every current document."""
    return _groups(spark, folder)


def acl_readers(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each principal reads."""
    return access.readers(_groups(spark, folder), principals(spark, folder))


def acl_group_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and holders of every group."""
    used = _groups(spark, folder).select("path", F.explode("groups").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("documents"))
    held = principals(spark, folder).filter(~F.col("admin")).select("principal", F.explode("groups").alias("grp")).groupBy("grp").agg(F.array_sort(F.collect_set("principal")).alias("holders"))
    return used.join(held, "grp", "full_outer").select("grp", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.array_join("holders", ","), F.lit("")).alias("holders"))


def acl_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What an administrator should look at."""
    collections = table(spark, folder, "collections").select(F.coalesce("declared_groups", F.array().cast("array<string>")).alias("groups"))
    return access.warnings(_groups(spark, folder), principals(spark, folder), collections).distinct()


def collections_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every directory in use, with all above it and the documents below it."""
    documents = _documents(spark, folder)
    below = documents.select(F.explode(access.ancestors(F.col("directory"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("documents"))
    return access.collection_tree(documents).join(below, "path")


def user_import_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What importing suppliers as users over the customers would do."""
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("username"), F.array(F.col("c_nationkey").cast("string")).alias("groups"))
    new = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("username"), F.array(F.col("s_nationkey").cast("string")).alias("groups"))
    return import_plan(old, new).select("username", "action")


DOCUMENT_GROUPS = f"""
docs_now as (select path, coalesce(collection, '') directory, declared_groups from {current_sql("docs", "path")}),
dirs as (select distinct directory from docs_now),
chain as (
  select directory, i depth, case when i = 0 then '' else array_to_string(string_split(directory, '/')[1:i], '/') end path
  from (select directory, unnest(range(0, case when directory = '' then 1 else len(string_split(directory, '/')) + 1 end)) i from dirs)),
rules as (
  select c.directory, s.path governed_by, s.declared_groups
  from chain c join collections s on s.path = c.path where s.declared_groups is not null
  qualify row_number() over (partition by c.directory order by depth desc) = 1),
directory_groups as (select directory, coalesce(list_sort(list_distinct(declared_groups)), []::varchar[]) groups, governed_by from dirs left join rules using (directory)),
document_groups as (select path, list_sort(list_distinct(list_filter(coalesce(d.declared_groups, g.groups), lambda x: x is not null))) groups from docs_now d join directory_groups g using (directory))"""


def queries() -> dict:
    return {f.__name__: f for f in (acl_directories, acl_effective, acl_readers, acl_group_documents, acl_warnings, collections_tree, user_import_plan)}


def oracle_sql() -> dict[str, str]:
    base = f"with {PRINCIPALS}, {DOCUMENT_GROUPS}"
    return {
        "acl_directories": f"{base} select directory, groups, governed_by from directory_groups",
        "acl_effective": f"{base} select path, groups from document_groups",
        "acl_readers": f"{base}, seen as (select distinct principal, path from (select path, unnest(groups) grp from document_groups) join (select principal, unnest(groups) grp from principals where not admin) using (grp)) select p.principal, case when p.admin then (select count(*) from document_groups) else (select count(*) from seen s where s.principal = p.principal) end as readable from principals p",
        "acl_group_documents": f"{base}, u as (select grp, count(*) n from (select unnest(groups) grp from document_groups) group by 1), h as (select grp, string_agg(distinct principal, ',' order by principal) p from (select principal, unnest(groups) grp from principals where not admin) group by 1) select coalesce(u.grp, h.grp) as grp, coalesce(n, 0) as documents, coalesce(p, '') as holders from u full join h on u.grp = h.grp",
        "acl_warnings": f"{base}, used as (select distinct unnest(groups) subject from document_groups), held as (select distinct unnest(groups) subject from principals where not admin), decl as (select distinct unnest(declared_groups) subject from collections) select 'unheld group' as kind, subject from used where subject not in (select subject from held) union all select 'admin only', path from document_groups where len(groups) = 0 union all select 'no groups', principal from principals where not admin and len(groups) = 0 union all select 'unused group', subject from held where subject not in (select subject from used union select subject from decl)",
        "collections_tree": f"{base}, every as (select path, c.directory from chain c), n as (select e.path, count(*) documents from every e join docs_now d using (directory) group by 1) select path, case when path = '' then null when instr(path, '/') = 0 then '' else regexp_replace(path, '/[^/]*$', '') end as parent, documents from n",
        "user_import_plan": "select coalesce(s_suppkey, c_custkey) as username, case when c_custkey is null then 'create' when s_suppkey is null then 'missing' when c_nationkey = s_nationkey then 'unchanged' else 'update' end as action from customer full join supplier on c_custkey = s_suppkey",
    }
