"""Queries of the semantic channel, fusion, neighbours, selection and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, fusion, semantic
from ..sources.tables import current_rows, table
from .common import current_sql
from .lexical_queries import HITS, _hits


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest embeddings of every one whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings")
    return semantic.nearest(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


def _channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both channels over documents that have an embedding of their id."""
    lexical = _hits(spark, folder, 50)
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return lexical, semantic.nearest(rows.filter("doc_id % 50 = 0"), rows, "doc_id", "embedding", 50)


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Fused candidates of both channels."""
    fused = fusion.fuse(*_channels(spark, folder), "doc_id")
    return fused.select("qid", "doc_id", "lex_rank", "sem_rank", F.round("rrf", 6).alias("rrf"), "pos")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Fused candidates reranked by the cosine of their embedding, where it was found."""
    lexical, near = _channels(spark, folder)
    fused = fusion.fuse(lexical, near, "doc_id")
    return fusion.reranked(fused, near.select("qid", "doc_id", "score"), "doc_id")


def rerank_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates in reranked order, unscored ones last."""
    return _ranked(spark, folder).select("qid", "doc_id", "rerank", "pos", "final_pos")


def select_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The 8 best above a least score of 0.2."""
    return fusion.selected(_ranked(spark, folder), 8, 0.2).select("qid", "doc_id", "rerank", "place")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks next to each other in a section."""
    rows = current_rows(table(spark, folder, "chunks").select("chunk_id", "section_id", "ordinal", "ingested_at"), "chunk_id")
    return fusion.neighbours(rows)


def _selected_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All current chunks of documents; those of 150 tokens or more count as selected."""
    columns = ["chunk_id", "doc_path", "section_id", "ordinal", "text", "tokens", "char_start", "char_end", "ingested_at"]
    rows = current_rows(table(spark, folder, "chunks").select(*columns), "chunk_id").filter("doc_path is not null")
    return rows.withColumn("selected", F.coalesce(F.col("tokens") >= 150, F.lit(False))).withColumn("priority", F.col("ordinal"))


def passage_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive chunks of a section with their range and length of text."""
    found = context.passages(_selected_chunks(spark, folder), "doc_path", "section_id")
    return found.select("doc_path", "section_id", "first_ordinal", "chunks", "char_start", "char_end", "priority", F.length("text").alias("characters"))


NEAR = """
u{0} as (select vec_id id, list_transform(embedding, lambda x: x::double) v from embeddings),
n{0} as (select id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from u{0}),
near{0} as (
  select q.id qid, r.id, round(list_dot_product(q.v, r.v), 6) score from n{0} q, n{0} r where q.id % 50 = 0 and r.id <> q.id
  qualify row_number() over (partition by q.id order by score desc, r.id) <= {0}),
sem{0} as (select *, row_number() over (partition by qid order by score desc, id) as rank from near{0})"""
FUSED = f"""
{HITS}, {NEAR.replace("{0}", "50")},
lex as (select * from ranked where rank <= 50),
fused0 as (
  select coalesce(l.qid, s.qid) qid, coalesce(l.doc_id, s.id) doc_id, l.rank lex_rank, s.rank sem_rank, s.score rerank,
    coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0) rrf
  from lex l full join sem50 s on l.qid = s.qid and l.doc_id = s.id),
fused as (select *, row_number() over (partition by qid order by rrf desc, coalesce(lex_rank, 2147483647), coalesce(sem_rank, 2147483647), doc_id) pos from fused0 qualify pos <= 40),
final as (select *, row_number() over (partition by qid order by rerank is null, rerank desc, pos) final_pos from fused)"""
POOL = f"pool as (select *, coalesce(tokens >= 150, false) selected from {current_sql('chunks', 'chunk_id')} where doc_path is not null)"


def queries() -> dict:
    return {f.__name__: f for f in (knn_topk, rrf_fuse, rerank_merge, select_threshold, neighbours, passage_islands)}


def oracle_sql() -> dict[str, str]:
    return {
        "knn_topk": f"with {NEAR.replace('{0}', '10')} select qid, id as vec_id, score, rank from sem10",
        "rrf_fuse": f"with {FUSED} select qid, doc_id, lex_rank, sem_rank, round(rrf, 6) as rrf, pos from fused",
        "rerank_merge": f"with {FUSED} select qid, doc_id, rerank, pos, final_pos from final",
        "select_threshold": f"with {FUSED} select qid, doc_id, rerank, row_number() over (partition by qid order by final_pos) as place from final where rerank >= 0.2 qualify place <= 8",
        "neighbours": f"with c as {current_sql('chunks', 'chunk_id')} select a.chunk_id, b.chunk_id as neighbour_id from c a join c b on a.section_id = b.section_id and abs(a.ordinal - b.ordinal) <= 1 and a.chunk_id <> b.chunk_id",
        "passage_islands": f"with {POOL}, i as (select *, ordinal - row_number() over (partition by doc_path, section_id order by ordinal) island, lag(char_end) over (partition by doc_path, section_id order by ordinal) before from pool), r as (select doc_path, section_id, island, min(ordinal) first_ordinal, count(*) chunks, min_by(char_start, ordinal) char_start, max(char_end) char_end, min(ordinal) filter (selected) priority, bool_or(selected) s from i group by 1, 2, 3), t as (select doc_path, section_id, island, ordinal, text, char_start, char_end, row_number() over (partition by doc_path, section_id, island order by ordinal) k, max(char_end) over (partition by doc_path, section_id, island order by ordinal rows between unbounded preceding and 1 preceding) e from i), l as (select doc_path, section_id, island, sum(case when k = 1 then length(text) when char_start >= e then 2 + length(text) else greatest(0, length(text) - (e - char_start)) end)::int characters from t group by 1, 2, 3) select r.doc_path, r.section_id, first_ordinal, chunks, char_start, char_end, priority, characters from r join l on l.doc_path = r.doc_path and l.section_id is not distinct from r.section_id and l.island = r.island where s",
    }
