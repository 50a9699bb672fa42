"""Equi-joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Keys that hold more than ``1 / share`` of all rows: fewer than ``share`` of them, whatever
    the size of the rows, so that they may be broadcast.  Null keys join nothing and are none."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share > F.col("_total")).select(*keys).dropna()  # one row


def salt(salts: int, *columns: str) -> Column:
    """A number below ``salts`` by the hash of some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def every_salt(salts: int) -> Column:
    """All numbers below ``salts``, one row each."""
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def meeting(asked: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """Every row of ``asked`` with every row of ``held``, which are spread over the partitions of a
    shuffle by the hash of ``by`` and move once; both hold blocks of many rows."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = asked.withColumn("_part", every_salt(parts)), held.withColumn("_part", salt(parts, by))
    return a.join(b.hint("merge"), "_part").drop("_part")


def gathered(asked: DataFrame, held: DataFrame, by: str, parts: int) -> DataFrame:
    """The rows of ``held``, spread over ``parts`` by the hash of ``by``, and after those of a part all
    rows of ``asked``: ``_part, _asks``, the columns of ``asked``, those of ``held``, null where the row
    has none.  Nothing is paired, so each part takes either side once, and no part is cut or stands
    with another in a task."""
    a = asked.withColumn("_part", every_salt(parts)).withColumn("_asks", F.lit(True))
    b = held.withColumn("_part", salt(parts, by)).withColumn("_asks", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True).select("_part", "_asks", *asked.columns, *held.columns)
    return both.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_asks")


def split_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 32, share: int = 1000) -> DataFrame:
    """``many`` joined with ``few`` on the keys; rows of a key that is hot in ``many`` are spread by
    the hash of ``by`` and meet a copy of the few rows of that key in each of ``salts`` tasks."""
    hot = F.broadcast(hot_keys(many, keys, share).withColumn("_hot", F.lit(True)))  # fewer than share rows
    a = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt(salts, *by)).otherwise(F.lit(0))).drop("_hot")
    b = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def split_pairs(rows: DataFrame, keys: list[str], by: str, hot: DataFrame | None = None, blocks: int = 16, share: int = 1000) -> DataFrame:
    """Pairs of rows of one key with ``a.by < b.by``, as ``a.*`` and ``b.*`` of the aliases a and b.

    The rows of a hot key are cut into blocks, and every two of its blocks meet in a
    group of their own, so that no group holds more than two blocks.  ``hot``: the
    hot keys, where they are known and bounded.
    """
    if hot is None:
        hot = hot_keys(rows, keys, share)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    own = marked.withColumn("_own", F.when(F.col("_hot"), salt(blocks, by)).otherwise(F.lit(0)))
    two = F.when(F.col("_hot"), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("_own"), j).alias("i"), F.greatest(F.col("_own"), j).alias("j"))))
    placed = own.withColumn("_two", F.explode(F.coalesce(two, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))))).drop("_hot")
    a, b = placed.alias("a"), placed.alias("b")
    same = F.col("a._two") == F.col("b._two")
    for key in keys:
        same = same & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    once = (F.col("a._own") != F.col("b._own")) | (F.col("a._two.i") == F.col("a._two.j"))
    return a.join(b, same & once & (F.col(f"a.{by}") < F.col(f"b.{by}")))
