"""Fusing, expanding, reranking and selecting candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import access
from .skew import split_join


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, k: int = 60, limit: int = 40) -> DataFrame:
    """Reciprocal rank fusion of two channels (``qid, key, score, rank``).

    A channel that lacks a candidate adds nothing.  Ties: the better lexical rank,
    then the better semantic rank, then the smaller key.
    """
    a = lexical.select("qid", key, F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"))
    b = semantic.select("qid", key, F.col("rank").alias("sem_rank"), F.col("score").alias("sem_score"))
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    fused = a.join(b, ["qid", key], "full_outer").withColumn("rrf", part("lex_rank") + part("sem_rank"))
    last = F.lit(2147483647)
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.coalesce("lex_rank", last), F.coalesce("sem_rank", last), key)
    return fused.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)


def neighbours(chunks: DataFrame, radius: int = 1) -> DataFrame:
    """``chunk_id, neighbour_id`` of the same section within the radius, not itself.

    An equi-join on section and a bucket of ordinals, so that a section of any
    length is spread over its buckets; the distance is a residual.
    """
    width = max(2 * radius, 64)
    a = chunks.select("section_id", "chunk_id", "ordinal", F.explode(F.array_distinct(F.array(*[F.floor((F.col("ordinal") + d) / width) for d in (-radius, radius)]))).alias("bucket"))
    b = chunks.select("section_id", F.col("chunk_id").alias("neighbour_id"), F.col("ordinal").alias("other"), F.floor(F.col("ordinal") / width).alias("bucket"))
    near = (F.abs(F.col("other") - F.col("ordinal")) <= radius) & (F.col("chunk_id") != F.col("neighbour_id"))
    return a.join(b, ["section_id", "bucket"]).filter(near).select("chunk_id", "neighbour_id").distinct()


def linked(links: DataFrame, sources: DataFrame, documents: DataFrame, principals: DataFrame) -> DataFrame:
    """Documents one link away, in either direction, of each query's sources.

    ``links``: ``src, dst``; ``sources``: ``qid, principal, path, pos``; ``documents``: ``path,
    groups``.  Both ends must be readable; the sources are left out.  ``via`` lists
    the sources in their order.  The links of a page that a large part of all pages
    link to are spread over several tasks.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    held = access.readable_hits(sources, documents, principals).withColumnRenamed("path", "src")
    reached = split_join(both, held, ["src"], ["dst"]).select("qid", "principal", F.col("dst").alias("path"), F.struct("pos", F.col("src").alias("via")).alias("hop"))
    met = reached.groupBy("qid", "principal", "path").agg(F.transform(F.array_sort(F.collect_set("hop")), lambda h: h["via"]).alias("via"))
    return access.readable_hits(met.join(sources.select("qid", "path"), ["qid", "path"], "left_anti"), documents, principals)


def reranked(candidates: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Candidates (``qid, key, pos``) in the order of a reranker's scores.

    Scored ones first by score and then input position, the others after them in
    input order with a null score; a query whose reranker failed has no scores and
    keeps its order.
    """
    met = candidates.join(scores.select("qid", key, F.col("score").alias("rerank")), ["qid", key], "left")
    order = Window.partitionBy("qid").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "pos")
    return met.withColumn("final_pos", F.row_number().over(order))


def selected(ranked: DataFrame, final_k: int = 8, least: float | None = None, reranked_column: Column | None = None) -> DataFrame:
    """The first ``final_k`` above the least score; with a least score and a reranker
    that ran, unscored candidates are dropped."""
    passing = ranked
    if least is not None:
        ran = reranked_column if reranked_column is not None else F.lit(True)
        passing = ranked.filter(~ran | F.coalesce(F.col("rerank") >= least, F.lit(False)))
    order = Window.partitionBy("qid").orderBy("final_pos")
    return passing.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= final_k)
