"""Mixing sources to target weights by Sainte-Lague apportionment.

A mix is cut into blocks of equal tokens.  The blocks go one after the other to
the source with the highest quotient ``weight / (2 * blocks so far + 1)`` until
the mix is full, a source leaving when its documents, each repeated as often as
allowed, are used up.  The blocks of a source go to its shards in the same way,
by the shards' tokens.  In each shard the documents stand in a seeded order, cut
into the same blocks; a quota takes whole rounds over the shard and then the
first blocks of the order.

Only sums per source and per shard (bounded by ``shards`` and the length of the
mix list) are apportioned in one task each; documents are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .encoding import token_count


@dataclass(frozen=True)
class MixOptions:
    """``blocks`` of a mix, of one token at least: a source whose target is below half a block
    gets none.  A source has a shard per ``shard_tokens``, ``shards`` at most; beyond
    that its shards grow (a shard is sorted by one task, on disk where it must)."""

    blocks: int = 1_000_000
    shard_tokens: int = 2_000_000
    shards: int = 100_000
    seed: int = 3


def apportion(weights: np.ndarray, capacity: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 * seats + 1)``, none above its capacity.

    The seats of all are ``floor(x * weight + 1/2)`` for one x (the divisor form
    of the same rule), so x is found by bisection and the last seats, which tie
    within the precision of x, go by quotient and then by position.
    """
    weights = np.where(capacity > 0, np.maximum(np.nan_to_num(weights), 0), 0).astype(float)
    seats = int(min(seats, capacity[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    given = lambda x: np.minimum(np.floor(x * weights + 0.5), capacity)
    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    got = given(low)
    while got.sum() < seats:
        quotient = np.where(got < capacity, weights / (2 * got + 1), -1)
        got[int(quotient.argmax())] += 1
    return got.astype(np.int64)


def plain_source(source: Column) -> Column:
    """A source name in its plain form: trimmed, lower case."""
    return F.lower(F.trim(source))


def measured(documents: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of every document, kept for the stages that follow."""
    sized = documents.select(F.col(key).alias("doc_id"), plain_source(F.col("source")).alias("source"), token_count(F.col("text"), path).alias("tokens"))
    return kept(sized, "sizes")


def _quotas(cells: DataFrame, group: list[str], order: str, schema: str) -> DataFrame:
    """Adds ``blocks``: seats of each cell by ``weight``, ``capacity`` and the group's ``seats``."""

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        frame["blocks"] = apportion(frame["weight"].to_numpy(float), frame["capacity"].to_numpy(), int(frame["seats"].iloc[0]))
        return frame

    return cells.groupBy(*group).applyInPandas(share, schema)


def plan(sizes: DataFrame, targets: DataFrame, o: MixOptions = MixOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards with their documents' tokens, quotas per source, and quotas per shard."""
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    used = sizes.filter("source is not null and tokens > 0")
    by_source = used.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    shard_count = F.least(F.lit(o.shards), F.ceil(F.col("source_tokens") / o.shard_tokens)).cast("int").alias("shard_count")
    counts = F.broadcast(by_source.join(targets.select(plain_source(F.col("source")).alias("source")).distinct(), "source").select("source", shard_count))  # at most as many as the mix list names
    sharded = used.join(counts, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(o.seed)), F.col("shard_count")).cast("int")).drop("shard_count")
    shards = sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    wanted = (
        targets.filter("mix_id is not null")
        .distinct()
        .groupBy("mix_id", plain_source(F.col("source")).alias("source"))
        .agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )
    block = F.greatest(F.col("total") / o.blocks, F.lit(1.0))
    room = lambda tokens: F.ceil(F.col("max_repeats") * F.coalesce(tokens, F.lit(0)) / F.col("block"))
    cells = (
        wanted.join(by_source, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("block", block)
        .select("mix_id", "source", "weight", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), "total", "block", room(F.col("source_tokens")).alias("capacity"), F.ceil(F.col("total") / F.col("block")).alias("seats"))
    )
    schema = "mix_id string, source string, weight double, max_repeats int, source_tokens long, total long, block double, capacity long, seats long, blocks long"
    sources = kept(_quotas(cells, ["mix_id"], "source", schema), "quotas")
    inside = (
        sources.filter("blocks > 0")
        .join(shards, "source")
        .select("mix_id", "source", "shard", F.col("shard_tokens").cast("double").alias("weight"), "max_repeats", "shard_tokens", "block", room(F.col("shard_tokens")).alias("capacity"), F.col("blocks").alias("seats"))
    )
    schema = "mix_id string, source string, shard int, weight double, max_repeats int, shard_tokens long, block double, capacity long, seats long, blocks long"
    return sharded, sources, _quotas(inside, ["mix_id", "source"], "shard", schema)


def mixed(sizes: DataFrame, targets: DataFrame, o: MixOptions = MixOptions()) -> tuple[DataFrame, DataFrame]:
    """The chosen documents of each mix, and the actual shares of its sources.

    Chosen: ``mix_id, source, doc_id, tokens, repeats`` (once or more).  Shares:
    one row per mix and source with the target and the actual share.  Documents
    of null source or without tokens are never chosen, but count in the total; a
    source named in other case or spacing is the same source, so the weights of its
    entries in a mix are added and the most repeats hold (an entry that is repeated
    in every column counts once); null and negative weights are 0; a mix whose sources cannot fill the total stays smaller; empty
    tables give empty mixes.
    """
    sharded, sources, quotas = plan(sizes, targets, o)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(o.seed + 1)), "doc_id")
    placed = sharded.withColumn("middle", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2)
    quota = F.least(F.col("blocks") * F.col("block"), (F.col("max_repeats") * F.col("shard_tokens")).cast("double"))
    asked = quotas.filter("blocks > 0").select("mix_id", "source", "shard", "max_repeats", "shard_tokens", quota.alias("quota"))
    rounds = F.floor(F.col("quota") / F.col("shard_tokens"))
    repeats = F.least(rounds + F.when(F.col("middle") < F.col("quota") - rounds * F.col("shard_tokens"), 1).otherwise(0), F.col("max_repeats")).cast("int")
    chosen = placed.join(asked, ["source", "shard"]).select("mix_id", "source", "doc_id", "tokens", repeats.alias("repeats")).filter("repeats > 0")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    per_mix = Window.partitionBy("mix_id")
    actual = F.coalesce("actual_tokens", F.lit(0))
    shares = sources.join(got, ["mix_id", "source"], "left").select(
        "mix_id", "source", "weight", "max_repeats", "source_tokens",
        F.try_divide(F.col("weight"), F.sum("weight").over(per_mix)).alias("target_share"),
        F.try_divide(F.col("weight") * F.col("total"), F.sum("weight").over(per_mix)).alias("target_tokens"),
        F.col("blocks").alias("quota_blocks"), actual.alias("actual_tokens"),
        F.try_divide(actual.cast("double"), F.sum(actual).over(per_mix)).alias("actual_share"),
        (F.col("blocks") == F.col("capacity")).alias("capped"), "block",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return chosen, shares
