"""Queries of ingest: differences, hashes, links, reuse, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, parsing
from ..operators.parsing import declared_groups
from ..sources.tables import current_rows, spread, table
from .common import current_sql


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they were one version ago, and as they are now without removed ones."""
    rows = ingest.versions(table(spark, folder, "docs"), "path").select("path", "hash", "content_hash", F.array_sort(F.col("effective_groups")).alias("groups"), "ingested_at", "version")
    gone = table(spark, folder, "removals").groupBy("path").agg(F.max("removed_at").alias("removed_at"))
    now = rows.filter("version = 1").join(gone, "path", "left").filter("removed_at is null or removed_at < ingested_at")
    return rows.filter("version = 2"), now.withColumn("problem", F.when(F.col("groups").isNull(), "no permissions"))


def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Status of every document between its version before and now."""
    return ingest.manifest_diff(*_sides(spark, folder))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Content hash of every document."""
    return table(spark, folder, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "docs").select("path", "title", "raw_links", "ingested_at"), "path")


def link_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every written link of current documents and the document it means."""
    return ingest.resolved_links(_docs(spark, folder)).groupBy("path", "raw", "target").agg(F.count(F.lit(1)).alias("written"))


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct links between documents."""
    return ingest.document_links(ingest.resolved_links(_docs(spark, folder)))


def vector_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Current chunks that keep the vector of their version before."""
    rows = ingest.versions(table(spark, folder, "chunks").select("chunk_id", "index_text", "vec", "ingested_at"), "chunk_id")
    return ingest.reusable_vectors(rows.filter("version = 2"), rows.filter("version = 1"))


def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the run that made the current state."""
    chunks = ingest.versions(table(spark, folder, "chunks").select("chunk_id", "tokens", "ingested_at"), "chunk_id").filter("version = 1")
    unresolved = ingest.resolved_links(_docs(spark, folder)).filter("target is null")
    return ingest.report(manifest_diff(spark, folder), chunks, unresolved)


def dup_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with one text, by its hash, with how often it stands."""
    hashed = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def doc_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Title of every document: front matter, else first heading, else base name."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "path", "text"))
    titles = parsing.titles(documents.select(F.col("doc_id").alias("key"), "path", F.coalesce("text", F.lit("")).alias("text")))
    return titles.select(F.col("key").alias("doc_id"), "title")


def frontmatter_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``read_groups`` of the front matter of every document, and whether they are malformed."""
    found = table(spark, folder, "documents").select("doc_id", *declared_groups(F.col("text")))
    return found.select("doc_id", F.array_sort(F.array_distinct("declared_groups")).alias("read_groups"), F.col("problem").isNotNull().alias("malformed"))


SIDES = """
versions as (
  select path, hash, content_hash, list_sort(effective_groups) groups, ingested_at, row_number() over (partition by path order by ingested_at desc) v
  from (select distinct on (path, ingested_at) * from docs where path is not null)),
o as (select * from versions where v = 2),
n as (select v.* from versions v left join (select path, max(removed_at) r from removals group by 1) g using (path) where v = 1 and (r is null or r < ingested_at)),
diff as (
  select coalesce(n.path, o.path) as path, case
    when n.path is null then 'deleted' when n.groups is null then 'error'
    when o.path is not null and n.hash = o.hash then case when n.groups is not distinct from o.groups then 'skipped' else 'acl-updated' end
    when o.path is null then 'added' when n.content_hash = o.content_hash then 'acl-updated' else 'updated' end as status
  from o full join n on o.path = n.path)"""
LINKS = f"""
now_docs as {current_sql("docs", "path")},
plinks as (
  select path, raw, url_decode(replace(regexp_replace(raw, '[#?].*$', '', 's'), '+', '%2B')) plain, regexp_replace(path, '/?[^/]*$', '') dir
  from (select path, unnest(raw_links.paths) raw from now_docs) where raw is not null),
good as (
  select path, raw, [x for x in string_split(case when dir = '' then plain else dir || '/' || plain end, '/') if x not in ('', '.')] parts, row_number() over () id
  from plinks where regexp_matches(plain, '(?i)\\.(md|markdown)$') and not regexp_matches(plain, '^[a-zA-Z][a-zA-Z0-9+.-]*:') and not starts_with(plain, '/')),
walk as (
  select id, path, raw, parts, 1 i, []::varchar[] done from good
  union all
  select id, path, raw, parts, i + 1, case when done is null then null when parts[i] <> '..' then list_append(done, parts[i]) when len(done) > 0 then done[1:len(done) - 1] else null end
  from walk where i <= len(parts)),
meant as (select path, raw, array_to_string(done, '/') meant from walk where i = len(parts) + 1 and done is not null),
entries as (
  select path, 0 kind, lower(title) name from now_docs
  union all select path, 1, lower(regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '\\.[^.]+$', '')) from now_docs),
names as (select name, path target from entries where trim(name) <> '' qualify row_number() over (partition by name order by path, kind) = 1),
resolved as (
  select m.path, m.raw, d.path target from meant m left join now_docs d on d.path = m.meant
  union all
  select w.path, '[[' || w.wiki || ']]', n.target from (select path, unnest(raw_links.wiki) wiki from now_docs) w left join names n on n.name = lower(w.wiki) where w.wiki is not null)"""


def queries() -> dict:
    return {f.__name__: f for f in (manifest_diff, content_hash, link_resolve, document_links, vector_reuse, ingest_report, dup_texts, doc_titles, frontmatter_groups)}


def oracle_sql() -> dict[str, str]:
    front = r"regexp_extract(text, '^(---\r?\n.*?\r?\n---)', 1, 's')"
    return {
        "manifest_diff": f"with {SIDES} select path, status from diff",
        "content_hash": r"with f as (select doc_id, text, regexp_extract(text, '(^---\r?\n.*?\r?\n?---)', 1, 's') front from documents) select doc_id, sha256(case when front = '' then text else regexp_replace(front, '(?m)^read_groups:[^\n]*\n?', '', 'g') || substr(text, length(front) + 1) end) as content_hash from f",
        "link_resolve": f"with recursive {LINKS} select path, raw, target, count(*) as written from resolved group by 1, 2, 3",
        "document_links": f"with recursive {LINKS} select distinct path as src, target as dst from resolved where target is not null and target <> path",
        "vector_reuse": "with v as (select chunk_id, index_text, vec, row_number() over (partition by chunk_id order by ingested_at desc) v from (select distinct on (chunk_id, ingested_at) * from chunks where chunk_id is not null)) select n.chunk_id, o.chunk_id is not null as reused from (select * from v where v = 1) n left join (select * from v where v = 2 and vec is not null) o on o.chunk_id = n.chunk_id and o.index_text is not distinct from n.index_text",
        "ingest_report": f"with recursive {SIDES}, {LINKS}, c as (select tokens from {current_sql('chunks', 'chunk_id')}) select count(*) filter (status = 'added') as added, count(*) filter (status = 'updated') as updated, count(*) filter (status = 'acl-updated') as acl_updated, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'deleted') as deleted, count(*) filter (status = 'error') as error, (select count(*) from c) as chunks, (select max(tokens) from c) as longest_chunk, (select count(*) from resolved where target is null) as unresolved_links from diff",
        "dup_texts": "select sha256(text) as hash, count(*) as copies, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
        "doc_titles": rf"with f as (select doc_id, path, case when not ends_with(path, '.txt') then trim(regexp_extract({front}, '(?m)^title:[ \t]+([^\r\n]+)', 1)) end a, case when not ends_with(path, '.txt') then trim(regexp_extract(text, '(?m)^#[ \t]+([^\r\n]+)', 1)) end b from documents) select doc_id, coalesce(nullif(a, ''), nullif(b, ''), regexp_extract(path, '([^/]*?)(?:\.[^./]+)?$', 1)) as title from f",
        "frontmatter_groups": rf"""with f as (select doc_id, text, {front} f, regexp_replace(regexp_extract(text, '^((?:[^\n]*\n?){{0,30}})', 1, 's'), '(?sm)^#.*', '') head from documents),
            g as (select doc_id, len(regexp_extract_all(f || chr(10) || case when f = '' then head else replace(head, f, '') end, '(?im)^[ \t]*["'']?read[-_ ]?groups?["'']?[ \t]*[:：]')) loose, len(regexp_extract_all(f, '(?m)^read_groups:[ \t]+\[[^\]\r\n]*\][ \t]*\r?$')) good, list_filter(list_transform(string_split(regexp_extract(f, '(?m)^read_groups:[ \t]+\[([^\]\r\n]*)\][ \t]*\r?$', 1), ','), lambda x: regexp_replace(trim(x), '^"(.*)"$', '\1')), lambda x: x <> '') words from f),
            h as (select *, coalesce(loose > 0 and (loose <> 1 or good <> 1 or len(list_filter(words, lambda x: regexp_matches(x, '[''"\[\]{{}}:]'))) > 0), false) malformed from g)
            select doc_id, case when good = 1 and not malformed then list_sort(list_distinct(words)) end as read_groups, malformed from h""",
    }
