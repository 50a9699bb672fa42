"""Incremental ingest as joins between what is indexed and what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name, link_target, parent_directory
from .skew import split_join

#: Front matter, and its line of groups, which define the hash of the content.
FRONT = r"(?s)^---\r?\n.*?\r?\n?---"
GROUPS_LINE = r"(?m)^read_groups:[^\n]*\n?"


def content_hash(text: Column) -> Column:
    """SHA-256 of a text without the ``read_groups`` lines of its front matter, so
    that a change of permissions alone leaves it as it is."""
    front = F.regexp_extract(text, "(" + FRONT + ")", 1)
    bare = F.regexp_replace(front, GROUPS_LINE, "")
    whole = F.when(front == "", text).otherwise(F.concat(bare, F.substring(text, F.length(front) + 1, F.length(text))))
    return F.sha2(F.encode(whole, "UTF-8"), 256)


def manifest_diff(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """``path, status`` of every path on either side.

    ``indexed``: ``path, hash, content_hash, groups``; ``found`` also ``problem``.  In
    this order: a permission problem is an error (and removes a stale copy); an
    equal hash is skipped, or only its groups are updated; else the document is
    added, or (equal content) its groups are updated, or it is updated.  What is
    indexed and not found is deleted.  Null hashes are equal to nothing.
    """
    old = indexed.select("path", *[F.col(c).alias(f"old_{c}") for c in ("hash", "content_hash", "groups")], F.lit(True).alias("old"))
    new = found.select("path", "hash", "content_hash", "groups", "problem", F.lit(True).alias("new"))
    both = old.join(new, "path", "full_outer")
    status = (
        F.when(F.col("new").isNull(), "deleted")
        .when(F.col("problem").isNotNull(), "error")
        .when(F.col("old").isNotNull() & (F.col("hash") == F.col("old_hash")), F.when(F.col("groups").eqNullSafe(F.col("old_groups")), "skipped").otherwise("acl-updated"))
        .when(F.col("old").isNull(), "added")
        .when(F.col("content_hash") == F.col("old_content_hash"), "acl-updated")
        .otherwise("updated")
    )
    return both.select("path", status.alias("status"))


def changed_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """``path`` of indexed documents whose file is another now: who may read the file is not known
    before the next run, so only administrators are shown it."""
    return indexed.select("path", F.col("hash").alias("old")).join(found.select("path", "hash"), "path").filter(~F.col("old").eqNullSafe(F.col("hash"))).select("path")


def reusable_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """``chunk_id, reused``: whether a new chunk may keep the vector of the old chunk
    of its id, which it may if the indexed text is the same."""
    held = old.filter(F.col("vec").isNotNull()).select("chunk_id", F.xxhash64("index_text").alias("o1"), F.xxhash64(F.lit("o"), "index_text").alias("o2")).distinct()
    want = new.select("chunk_id", F.xxhash64("index_text").alias("o1"), F.xxhash64(F.lit("o"), "index_text").alias("o2")).distinct()
    return want.join(held.withColumn("held", F.lit(True)), ["chunk_id", "o1", "o2"], "left").select("chunk_id", F.coalesce("held", F.lit(False)).alias("reused"))


def names(docs: DataFrame) -> DataFrame:
    """``name, target``: lower-case titles and base names; the first path wins a name,
    a title before a base name."""
    entries = docs.select("path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lower("title").alias("name")), F.struct(F.lit(1).alias("kind"), F.lower(base_name(F.col("path"))).alias("name")))).alias("e"))
    named = entries.select("path", "e.kind", "e.name").filter(F.trim("name") != "")
    return named.groupBy("name").agg(F.min(F.struct("path", "kind"))["path"].alias("target"))


def resolved_links(docs: DataFrame) -> DataFrame:
    """``path, raw, target`` of every link of current documents (``path, title,
    raw_links``); ``target`` is null where it is unresolved.

    Path links that name no document file are no links.  Wiki links go by lower-case
    name.  What many documents link to is spread over several tasks.
    """
    paths = docs.select("path", F.explode("raw_links.paths").alias("raw")).filter(F.col("raw").isNotNull())
    paths = paths.select("path", "raw", link_target(parent_directory(F.col("path")), F.col("raw")).alias("meant")).filter(F.col("meant").isNotNull())
    there = docs.select(F.col("path").alias("meant"), F.col("path").alias("target"))
    by_path = split_join(paths, there, ["meant"], ["path"], "left").select("path", "raw", "target")
    wikis = docs.select("path", F.explode("raw_links.wiki").alias("wiki")).filter(F.col("wiki").isNotNull())
    wikis = wikis.select("path", F.concat(F.lit("[["), "wiki", F.lit("]]")).alias("raw"), F.lower("wiki").alias("name"))
    by_name = split_join(wikis, names(docs), ["name"], ["path"], "left").select("path", "raw", "target")
    return by_path.unionByName(by_name)


def document_links(resolved: DataFrame) -> DataFrame:
    """``src, dst``: distinct links between documents, none to itself."""
    return resolved.filter(F.col("target").isNotNull() & (F.col("target") != F.col("path"))).select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def versions(rows: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """Rows with ``version``: 1 for the latest of each key; redelivered rows once."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.filter(F.col(key).isNotNull()).dropDuplicates([key, at]).withColumn("version", F.row_number().over(order))


def report(statuses: DataFrame, chunks: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: documents by status, chunks, the longest chunk, unresolved links."""
    counted = statuses.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("added", "updated", "acl-updated", "skipped", "deleted", "error")])
    written = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.max("tokens").alias("longest_chunk"))
    return counted.crossJoin(written).crossJoin(unresolved.agg(F.count(F.lit(1)).alias("unresolved_links")))  # one row each
