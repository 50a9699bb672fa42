"""The steps of a search over chunks, from raw hits to selected chunks.

Every frame holds many queries, one row per query and chunk.  The engine runs the
steps over its store, the registered queries over the given tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import access, fusion

CHANNELS = ("lexical", "semantic")
LAST = 2147483647


@dataclass(frozen=True)
class SearchOptions:
    """Defaults of a search; ``channels``, ``rerank`` and ``graph`` choose its parts."""

    channel_k: int = 50
    overfetch: int = 4
    rrf_k: int = 60
    rerank_input: int = 40
    channels: tuple[str, ...] = CHANNELS
    rerank: bool = True
    graph: bool = True
    graph_sources: int = 5
    graph_chunks: int = 2
    graph_most: int = 10
    final_k: int = 8
    least: float | None = None
    budget: int = 6000

    def __post_init__(self):
        if not self.channels or not set(self.channels) <= set(CHANNELS):
            raise ValueError(f"channels must be some of {CHANNELS}")
        if not 1 <= self.final_k <= 50:
            raise ValueError("final_k must be from 1 to 50")


def placed(raw: DataFrame, owners: DataFrame, place: DataFrame) -> DataFrame:
    """Raw hits with the principal of their query and the document of their chunk."""
    return raw.select("qid", "channel", "chunk_id", "score", "rank").join(owners, "qid").join(place, "chunk_id")


def readable(hits: DataFrame, documents: DataFrame, principals: DataFrame) -> DataFrame:
    """Placed hits as their principal may see them, ranked after the filter in each channel."""
    order = Window.partitionBy("qid", "channel").orderBy("rank")
    return access.readable_hits(hits, documents, principals).withColumn("rank", F.row_number().over(order))


def counted(hits: DataFrame, ranked: DataFrame, o: SearchOptions) -> DataFrame:
    """Counts per query and channel of placed hits and of the readable ones among them."""
    each = lambda df, name: df.groupBy("qid", "channel").agg(F.count(F.lit(1)).alias(name))
    counts = each(hits, "raw_hits").join(each(ranked, "after_acl"), ["qid", "channel"], "left")
    starved = (F.col("raw_hits") >= o.channel_k * o.overfetch) & (F.col("after_acl") < o.channel_k)
    return counts.select("qid", "channel", "raw_hits", F.coalesce("after_acl", F.lit(0)).alias("after_acl")).withColumn("starved", starved)


def channel(raw: DataFrame, name: str, owners: DataFrame, place: DataFrame, documents: DataFrame, principals: DataFrame, o: SearchOptions) -> tuple[DataFrame, DataFrame]:
    """Hits of one channel as their principal may see them, and counts per query.

    ``raw``: ``qid, chunk_id, score, rank``, the best ``channel_k * overfetch``; ``owners``: ``qid,
    principal``; ``place``: ``chunk_id, path``.  All readable hits come out, ranked after the
    filter; the first ``channel_k`` are candidates.  Starved: as many hits as could
    be fetched, and fewer candidates than asked for.
    """
    hits = placed(raw.withColumn("channel", F.lit(name)), owners, place)
    ranked = readable(hits, documents, principals)
    return ranked, counted(hits, ranked, o)


def fused(ranked: DataFrame, o: SearchOptions) -> DataFrame:
    """Candidates of the chosen channels by reciprocal rank, ``rerank_input`` of each query."""
    sides = [ranked.filter((F.col("channel") == name) & F.lit(name in o.channels) & (F.col("rank") <= o.channel_k)) for name in CHANNELS]
    both = fusion.fuse(sides[0], sides[1], "chunk_id", o.rrf_k, o.rerank_input)
    known = ranked.select("qid", "principal", "chunk_id", "path").distinct()
    return both.join(known, ["qid", "chunk_id"])


def expanded(candidates: DataFrame, ranked: DataFrame, links: DataFrame, place: DataFrame, documents: DataFrame, principals: DataFrame, o: SearchOptions) -> DataFrame:
    """Chunks of documents one link away from the first documents of each query.

    None of a document that is among the candidates; of each linked document its
    best chunks by any channel, else its first one; documents with hits first, by
    their best rank, then the others by path; ``graph_most`` chunks in all, counted
    before it is known whether a first chunk exists.
    """
    first = candidates.groupBy("qid", "principal", "path").agg(F.min("pos").alias("pos"))
    sources = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).filter(F.col("n") <= o.graph_sources).drop("n")
    reached = fusion.linked(links, sources, documents, principals).join(first.select("qid", "path"), ["qid", "path"], "left_anti")
    hits = ranked.filter(F.col("channel").isin(*o.channels))
    best = hits.groupBy("qid", "path", "chunk_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("qid", "path").orderBy(F.col("rank").isNull(), "rank", "chunk_id")
    picked = reached.join(best, ["qid", "path"], "left").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= o.graph_chunks)
    picked = picked.withColumn("best", F.min(F.coalesce("rank", F.lit(LAST))).over(Window.partitionBy("qid", "path")))
    capped = picked.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("best", "path", "n"))).filter(F.col("place") <= o.graph_most)
    extra = capped.select("qid", "principal", F.coalesce("chunk_id", F.concat("path", F.lit("::0"))).alias("chunk_id"), "path", (F.lit(o.rerank_input) + F.col("place")).alias("pos"), "via")
    return extra.join(place.select("chunk_id"), "chunk_id", "left_semi")


def candidates(ranked: DataFrame, links: DataFrame, place: DataFrame, documents: DataFrame, principals: DataFrame, o: SearchOptions) -> DataFrame:
    """``qid, principal, chunk_id, path, pos, lex_rank, sem_rank, rrf, via``: fused candidates and,
    after them, those of the links."""
    found = fused(ranked, o).select("qid", "principal", "chunk_id", "path", "pos", "lex_rank", "sem_rank", "rrf")
    if not o.graph:
        return found.withColumn("via", F.lit(None).cast("array<string>"))
    return found.unionByName(expanded(found, ranked, links, place, documents, principals, o), allowMissingColumns=True)


def first_places(shown: DataFrame, key: str, at: str = "final_pos") -> DataFrame:
    """``qid, key, rank``: distinct keys of each query in the order in which they first stand."""
    firsts = shown.filter(F.col(key).isNotNull()).groupBy("qid", key).agg(F.min(at).alias("_at"))
    return firsts.select("qid", key, F.row_number().over(Window.partitionBy("qid").orderBy("_at")).alias("rank"))
