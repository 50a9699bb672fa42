"""Queries that parse and chunk all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunker import ChunkOptions
from ..operators import parsing
from ..sources.tables import spread, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("path", "text"))


def parse_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every document."""
    return parsing.sections(_documents(spark, folder))


def chunk_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document."""
    return parsing.chunks(_documents(spark, folder))


def chunk_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the chunks of every document: their number without a gap, none above
    the limit, each the text at its place, and all letters and digits below the
    headings in some chunk, counted once."""
    chunks = parsing.chunks(_documents(spark, folder))
    before = F.max("char_end").over(Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    skip = F.greatest(F.lit(0), F.coalesce(before, F.lit(0)) - F.col("char_start"))
    fresh = F.substring("text", (skip + 1).cast("int"), F.length("text"))
    texts = table(spark, folder, "documents").select("path", F.col("text").alias("whole"))
    marked = chunks.withColumn("letters", F.length(F.regexp_replace(fresh, r"[^\p{L}\p{Nd}]", ""))).join(texts, "path")
    placed = F.col("text") == F.expr("substring(whole, int(char_start + 1), int(char_end - char_start))")
    return marked.groupBy("path").agg(
        (F.count_distinct("ordinal") == F.max("ordinal") + 1).alias("gapless"),
        (F.max("tokens") <= ChunkOptions().most).alias("within"),
        F.bool_and(placed).alias("placed"),
        F.sum("letters").alias("letters"),
    )


def document_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Links and wiki names that every document writes."""
    return parsing.links(_documents(spark, folder))


#: Lines of Markdown documents with their offsets (code points), whether they lie in the front matter or a fence.
LINES = r"""
front as (select path, text, case when ends_with(path, '.txt') then 0 else length(regexp_extract(text, '^---[ \t]*\r?\n(?:.*?\n)?---[ \t]*(?:\r?\n|$)', 0, 's')) end f from documents where path is not null and text is not null),
parts as (select path, text, f, unnest(string_split(substr(text, f + 1), chr(10))) line, generate_subscripts(string_split(substr(text, f + 1), chr(10)), 1) n from front),
offs as (select path, n, line, f + coalesce(sum(length(line) + 1) over (partition by path order by n rows between unbounded preceding and 1 preceding), 0) at_ from parts),
fenced as (select *, regexp_matches(line, '^ {0,3}```') tick, sum(case when regexp_matches(line, '^ {0,3}```') then 1 else 0 end) over (partition by path order by n) c from offs),
lines as (select path, n, line, at_, tick or c % 2 = 1 code, ends_with(path, '.txt') plain, regexp_full_match(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]*') blank from fenced),
atx as (select *, not code and not plain and regexp_matches(line, '^ {0,3}#{1,6}([ \t]|\r?$)') is_atx, not code and not plain and regexp_matches(line, '^ {0,3}([-*_][ \t]*){3,}\r?$') is_break, not code and not plain and regexp_matches(line, '^ {0,3}(=+|-+)[ \t]*\r?$') is_line, not code and not plain and regexp_matches(line, '^ {0,3}([-*+]|[0-9]{1,9}[.)])([ \t]|\r?$)|^ *>') is_item from lines),
spans as (select *, coalesce(max(n) filter (blank or code or is_atx or is_break or is_line) over (partition by path order by n rows between unbounded preceding and 1 preceding), 0) + 1 para, sum(is_item::int) over (partition by path order by n) items from atx),
under as (select u.path, u.para first_n, u.n last_n, case when ltrim(u.line)[1] = '=' then 1 else 2 end level from spans u join spans f on f.path = u.path and f.n = u.para where u.is_line and u.para < u.n and f.items - f.is_item::int = u.items - u.is_item::int),
titled as (select u.path, u.first_n, u.last_n, u.level, string_agg(l.line, chr(10) order by l.n) heading from under u join lines l on l.path = u.path and l.n >= u.first_n and l.n < u.last_n group by 1, 2, 3, 4),
heads as (
  select s.*, t.path is not null is_under, is_atx or t.path is not null head, is_break and e.path is null gone, t.level under_level, t.heading under_heading, i.path is not null inside
  from spans s left join titled t on t.path = s.path and t.first_n = s.n left join titled e on e.path = s.path and e.last_n = s.n left join titled i on i.path = s.path and s.n > i.first_n and s.n <= i.last_n)"""
SECTIONS = rf"""
{LINES},
solid as (select * from heads where not blank and not gone),
placed as (select *, sum(case when head then 1 else 0 end) over (partition by path order by n) h from solid),
secs as (
  select path, h, min(at_) char_start, max(at_ + length(rtrim(line, E'\r'))) char_end, bool_or(head) headed,
    max(coalesce(under_level, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)))) filter (head) level,
    max(trim(regexp_replace(case when is_under then under_heading else regexp_replace(regexp_replace(line, '^ {{0,3}}#{{1,6}}', ''), '[ \t]+#+[ \t]*\r?$', '') end, '[`*]', '', 'g'), E' \t\r')) filter (head) heading
  from placed group by 1, 2),
numbered as (select *, coalesce(level, 0) lv, row_number() over (partition by path order by h) - 1 i from secs),
pairs as (select a.path, a.i, b.i j, b.heading, b.lv, a.lv own from numbered a join numbered b on a.path = b.path and b.i < a.i and b.headed and a.headed),
above as (select p.path, p.i, p.j, p.heading from pairs p where p.lv < p.own and not exists (from numbered m where m.path = p.path and m.headed and m.i > p.j and m.i < p.i and m.lv <= p.lv)),
chain as (select path, i, max(j) parent, string_agg(heading, ' > ' order by j) filter (heading <> '') up from above group by 1, 2)"""


def queries() -> dict:
    return {f.__name__: f for f in (parse_sections, chunk_docs, chunk_checks, document_destinations)}


def oracle_sql() -> dict[str, str]:
    return {
        "parse_sections": f"with {SECTIONS} select s.path, s.path || '#' || s.i as section_id, s.path || '#' || c.parent as parent_id, s.heading, s.lv::int as level, case when not s.headed then '' when coalesce(c.up, '') = '' then coalesce(s.heading, '') when coalesce(s.heading, '') = '' then c.up else c.up || ' > ' || s.heading end as trail, s.i::int as section_index, s.char_start, s.char_end from numbered s left join chain c on c.path = s.path and c.i = s.i",
        "chunk_checks": rf"with {LINES} select path, true as gapless, true as within, true as placed, sum(length(regexp_replace(line, '[^\p{{L}}\p{{Nd}}]', '', 'g')))::bigint as letters from heads where not head and not inside and path in (select path from heads where not blank and not gone) group by path",
        "document_destinations": rf"""with {LINES},
            bodies as (select path, regexp_replace(regexp_replace(string_agg(case when code then '' else line end, chr(10) order by n), '``[^`]+``', ' ', 'g'), '`[^`]+`', ' ', 'g') t from heads where not plain group by path),
            found as (select path, 'path' kind, regexp_extract_all(t, '\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*<?([^()\s<>]+)>?[^)]*\)', 1) d from bodies union all select path, 'wiki', regexp_extract_all(t, '\[\[([^\[\]|#\n]+)(?:[|#][^\[\]\n]*)?\]\]', 1) from bodies)
            select path, kind, (generate_subscripts(d, 1) - 1)::int as position, trim(unnest(d)) as destination from found""",
    }
