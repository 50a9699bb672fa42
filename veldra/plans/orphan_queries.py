"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import orphan_counts, orphans
from ..sources.tables import table


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(*(table(spark, folder, name) for name in ("docs", "removals", "sections", "chunks")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference whose target is not live or came later."""
    return _cases(spark, folder).select("src_table", "src_key", "target")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per referring table and month."""
    return orphan_counts(_cases(spark, folder))


CASES = r"""
with recursive live as (
  select d.path, d.first_at, d.latest_at, d.links_to
  from (select path, min(ingested_at) first_at, max(ingested_at) latest_at, arg_max_null(links_to, ingested_at) links_to from docs where path is not null group by path) d
  left join (select path, max(removed_at) removed_at from removals group by path) r on r.path = d.path
  where r.removed_at is null or r.removed_at < d.latest_at),
links as (
  select path src_key, latest_at at_, url_decode(replace(regexp_replace(link, '[#?].*$', '', 's'), '+', '%2B')) plain
  from (select path, latest_at, unnest(links_to) link from live) where link is not null and link <> ''),
docrefs as (
  select distinct src_key, at_, plain, [x for x in string_split(plain, '/') if x not in ('', '.')] parts
  from links where regexp_matches(plain, '(?i)\.(md|markdown)$') and not regexp_matches(plain, '^[a-zA-Z][a-zA-Z0-9+.-]*:') and not starts_with(plain, '/')),
walk as (
  select src_key, at_, plain, parts, 1 i, []::varchar[] done from docrefs
  union all
  select src_key, at_, plain, parts, i + 1,
    case when done is null then null when parts[i] <> '..' then list_append(done, parts[i]) when len(done) > 0 then done[1:len(done) - 1] else null end
  from walk where i <= len(parts)),
refs as (
  select 'docs' src_table, src_key, array_to_string(done, '/') target, at_ from walk where i = len(parts) + 1 and done is not null
  union all
  select 'sections', section_id, arg_max_null(doc_path, ingested_at), max(ingested_at) from sections where section_id is not null group by section_id
  union all
  select 'chunks', chunk_id, arg_max_null(doc_path, ingested_at), max(ingested_at) from chunks where chunk_id is not null group by chunk_id),
cases as (
  select distinct r.src_table, r.src_key, r.target, r.at_, l.path is not null late
  from refs r left join live l on l.path = r.target
  where r.target is not null and r.target <> '' and (l.path is null or l.first_at > r.at_))
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": CASES + "select src_table, src_key, target from cases",
        "p1_report": CASES + "select src_table, strftime(at_, '%Y-%m') as month, count(*) filter (not late) as missing, count(*) filter (late) as late, count(*) as orphans from cases group by 1, 2",
    }
