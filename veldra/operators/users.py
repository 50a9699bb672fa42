"""Importing users: what would be created, updated, or is missing from the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(listed: DataFrame) -> DataFrame:
    """``username, problem`` of every entry that may not be imported, all at once."""
    named = listed.filter(F.col("username").isNotNull() & (F.trim(F.col("username").cast("string")) != ""))
    twice = named.groupBy("username").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kinds = [
        (listed.filter(F.col("username").isNull() | (F.trim(F.col("username").cast("string")) == "")), "no name"),
        (twice, "listed twice"),
        (named.filter(F.col("groups").isNull() | F.exists("groups", lambda g: g.isNull() | (F.trim(g) == ""))), "groups are not a list of names"),
    ]
    parts = [df.select("username", F.lit(text).alias("problem")) for df, text in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def import_plan(known: DataFrame, listed: DataFrame) -> DataFrame:
    """``username, groups, action``: create, update, unchanged or missing; groups compare as sets."""
    sets = lambda df, name: df.select("username", F.array_sort(F.array_distinct("groups")).alias(name))
    both = sets(known, "old").join(sets(listed, "new"), "username", "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("update")
    return both.select("username", F.coalesce("new", "old").alias("groups"), action.alias("action"))
