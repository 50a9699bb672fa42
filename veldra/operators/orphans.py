"""References to records that do not exist, or came later.

The foreign keys of all referring tables are reduced to distinct keys with the
oldest referring time before anything is shuffled by key, so a key that a third
of all rows refer to costs one row per map task.  A left anti-join against the
parents finds the missing keys and an inner join the late ones; only these
problem keys are joined back to the references, salted by the referring row.

Defined results: null and empty foreign keys and links that name no document
are no references; rows of null key are no rows; repeated rows and repeated
references give one case; a removal at the very time of the latest arrival
removes; empty tables give no cases.  Other columns of the tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import link_target
from ..sources.tables import current_keys


def live_documents(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """``path``, ``first_at``, ``latest_at`` and ``links_to`` of the documents that are there."""
    held = (
        docs.filter(F.col("path").isNotNull())
        .groupBy("path")
        .agg(
            F.min("ingested_at").alias("first_at"),
            F.max("ingested_at").alias("latest_at"),
            F.max_by("links_to", F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(1 << 62)))).alias("links_to"),
        )
    )
    gone = removals.groupBy("path").agg(F.max("removed_at").alias("removed_at"))
    return (
        held.join(gone, "path", "left")
        .filter(F.col("removed_at").isNull() | (F.col("removed_at") < F.col("latest_at")))
        .drop("removed_at")
    )


def references(live: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every reference as ``src_table``, ``src_key``, ``target`` and ``at`` of the referring row."""
    links = (
        live.select("path", "latest_at", F.explode("links_to").alias("link"))
        .filter(F.col("link") != "")
        .select(
            F.lit("docs").alias("src_table"),
            F.col("path").alias("src_key"),
            link_target(F.lit(""), F.col("link")).alias("target"),
            F.col("latest_at").alias("at"),
        )
    )
    parts = [links]
    for name, key, rows in (("sections", "section_id", sections), ("chunks", "chunk_id", chunks)):
        current = current_keys(rows, key, ["doc_path", "ingested_at"])
        parts.append(current.select(F.lit(name).alias("src_table"), F.col(key).alias("src_key"), F.col("doc_path").alias("target"), F.col("ingested_at").alias("at")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.filter(F.col("target").isNotNull() & (F.col("target") != ""))


def orphans(docs: DataFrame, removals: DataFrame, sections: DataFrame, chunks: DataFrame, salts: int = 16) -> DataFrame:
    """One row per orphan reference: ``src_table, src_key, target, at, late``."""
    live = live_documents(docs, removals)
    refs = references(live, sections, chunks)
    parents = live.select(F.col("path").alias("target"), "first_at")
    keys = refs.groupBy("target").agg(F.min("at").alias("oldest_at"))
    missing = keys.join(parents, "target", "left_anti").select("target", F.lit(None).cast(parents.schema["first_at"].dataType).alias("first_at"))
    late = keys.join(parents, "target").filter(F.col("first_at") > F.col("oldest_at")).select("target", "first_at")
    problems = missing.unionByName(late).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("src_key"), F.lit(salts)).cast("int"))
    return (
        salted.join(problems, ["target", "salt"])
        .filter(F.col("first_at").isNull() | (F.col("first_at") > F.col("at")))
        .select("src_table", "src_key", "target", "at", F.col("first_at").isNotNull().alias("late"))
        .distinct()
    )


def orphan_counts(cases: DataFrame) -> DataFrame:
    """Orphan references per referring table and month of the referring row."""
    return cases.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count_if(~F.col("late")).alias("missing"),
        F.count_if("late").alias("late"),
        F.count(F.lit(1)).alias("orphans"),
    )
