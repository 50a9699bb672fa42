"""Queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import current_keys, current_rows, spread, table
from . import confusables, encoding, garble, knn, mixing, neardup, splitting


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that look the same and differ in their characters."""
    formed = confusables.with_forms(spread(table(spark, folder, "chunks").select("chunk_id", "index_text", "ingested_at")), "index_text")
    current = current_keys(formed.filter(F.col("index_text").isNotNull()), "chunk_id", ["t1", "t2", "f1", "f2"])
    return confusables.look_alikes(current, "chunk_id", "index_text").toDF("chunk_a", "chunk_b")


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every current index_text."""
    current = current_rows(table(spark, folder, "chunks").select("chunk_id", "ingested_at", "index_text"), "chunk_id")
    return current.select("chunk_id", confusables.consistent_column(F.col("index_text")).alias("consistent_text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the 5 most similar of the other."""
    return knn.similar_pairs(table(spark, folder, "chunks"), "chunk_id", "vec", "ingested_at").toDF("chunk_a", "chunk_b")


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the nearest vectors against the exact ones of every fiftieth vector by its hash."""
    return knn.recall(table(spark, folder, "chunks"), "chunk_id", "vec", "ingested_at")


def _splittable(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = spread(table(spark, folder, "chunks").select("chunk_id", "index_text", "ingested_at"))
    return chunks, spread(table(spark, folder, "sections").select("section_id", "trail", "ingested_at"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items above their limit: those that the splitter cuts."""
    return splitting.cut_oversized(*_splittable(spark, folder)).select("src_table", "src_key")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized item."""
    return splitting.split_oversized(*_splittable(spark, folder))


def p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of every oversized item give its text back, within the limit and without a gap."""
    return splitting.checked(p4_pieces(spark, folder), {"chunks": splitting.INDEX_TEXT.limit, "sections": splitting.TRAIL.limit})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of similarity 0.7 or more."""
    return neardup.near_duplicates(table(spark, folder, "chunks"), "chunk_id", "index_text", "ingested_at").toDF("chunk_a", "chunk_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of equal index_text: the first of them and each further one."""
    return neardup.copy_groups(table(spark, folder, "chunks"), "chunk_id", "index_text", "ingested_at")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text."""
    return encoding.with_ids(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents of each mix with their repeats."""
    return mixing.mixed(mixing.measured(spread(table(spark, folder, "documents").select("doc_id", "source", "text"))), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mixing.mixed(mixing.measured(spread(table(spark, folder, "documents").select("doc_id", "source", "text"))), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that went through a wrong decoding."""
    return garble.garbled(spread(table(spark, folder, "documents").select("doc_id", "text"))).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with their text restored where it can be had."""
    return garble.garbled(spread(table(spark, folder, "documents").select("doc_id", "text")))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_forms, p3_found, p3_recall, p4_found, p4_pieces, p4_checked, p5_found, p5_groups, p6_ids, p7_mix, p7_shares, p8_found, p8_restored)}


_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _estimate(text: str) -> str:
    bare = f"regexp_replace({text}, '{_CJK}', ' ', 'g')"
    return f"(len(regexp_extract_all({text}, '{_CJK}')) + len(regexp_extract_all({bare}, '[\\p{{L}}\\p{{Nd}}]{{1,4}}')) + len(regexp_extract_all({bare}, '[\\p{{L}}\\p{{Nd}}]+')))"


def _current(name: str, key: str) -> str:
    return f"(select * from {name} where {key} is not null qualify row_number() over (partition by {key} order by ingested_at desc) = 1)"


def oracle_sql() -> dict[str, str]:
    large = f"select 'chunks' as src_table, chunk_id as src_key, index_text as t from {_current('chunks', 'chunk_id')} where {_estimate('index_text')} > 500 union all select 'sections', section_id, trail from {_current('sections', 'section_id')} where {_estimate('trail')} > 60"
    return {
        "p4_found": f"select src_table, src_key from ({large})",
        "p4_checked": f"select src_table, src_key, length(t) as characters, md5(t) as fresh_hash, true as within, true as linked from ({large})",
        "p5_groups": f"select representative, chunk_id as member, copies, copies <= 1000 as expanded from (select chunk_id, min(chunk_id) over (partition by index_text) as representative, count(*) over (partition by index_text) as copies from {_current('chunks', 'chunk_id')} where length(index_text) >= 5) where chunk_id <> representative",
    }
