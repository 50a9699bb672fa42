"""Near-duplicate texts by min-max hashing.

A text is the set of its distinct 5-character substrings.  Under each of
``permutations`` random orders of the substrings both the smallest and the
largest are kept, so half as many hash evaluations give a signature of a given
length.  Bands of ``rows`` values (smallest ones, or largest ones, of as many
orders) are the keys under which texts meet; the similarity of texts that met is
then computed exactly from the texts.  Texts of similarity s meet with
probability 1 - (1 - s^rows)^bands: 0.997 at 0.7, 0.9999 at 0.75.

Equal texts are one text for all of this.  Only keys under which two texts met
are joined.  Band keys that many texts share, found in a sample by hash, are cut
into blocks that meet in groups of their own.  ``copies`` names every text's first
key and its further ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import split_join, split_pairs
from ..sources.tables import current_keys, fingerprint, kept


@dataclass(frozen=True)
class MinMaxOptions:
    """``threshold``: least similarity; ``width``: characters of a substring;
    ``expand``: groups of equal texts up to this size come out as all their
    pairs, larger ones as pairs of each member with the group's first key; null:
    all groups as all their pairs.  ``hot_sample``, ``hot_share``: a band key is hot
    that 16 texts and more than one in ``hot_share`` hold among one in ``hot_sample``
    of all texts, so that ``hot_share`` times the bands bounds their number."""

    threshold: float = 0.7
    width: int = 5
    permutations: int = 384
    rows: int = 8
    expand: int | None = 1000
    hot_sample: int = 64
    hot_share: int = 1000
    seed: int = 5


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finalizer of shifts and products)."""
    values = (values ^ (values >> np.uint64(30))) * MIX1
    values = (values ^ (values >> np.uint64(27))) * MIX2
    return values ^ (values >> np.uint64(31))


def substring_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all substrings of texts of at least that width, and where each text starts."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.zeros(len(joined) - width + 1, np.uint64)
    for i in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + joined[i : len(joined) - width + 1 + i]
    # substrings that would run over the end of a text are left out
    ends = np.cumsum(lengths)
    inside = np.ones(len(joined), bool)
    for i in range(1, width):
        inside[ends - i] = False
    counts = lengths - width + 1
    return mixed(hashes[inside[: len(hashes)]]).astype(np.uint32), np.concatenate([[0], np.cumsum(counts)[:-1]])


def band_keys(hashes: np.ndarray, starts: np.ndarray, o: MinMaxOptions) -> np.ndarray:
    """The band keys of each text, one row per text."""
    factors = np.random.default_rng(o.seed).integers(1, 1 << 32, o.permutations, dtype=np.uint32) | np.uint32(1)
    bands = o.permutations // o.rows
    low = np.empty((o.permutations, len(starts)), np.uint32)
    high = np.empty((o.permutations, len(starts)), np.uint32)
    ordered = np.empty_like(hashes)
    for i, factor in enumerate(factors):
        np.multiply(hashes, factor, out=ordered)
        np.minimum.reduceat(ordered, starts, out=low[i])
        np.maximum.reduceat(ordered, starts, out=high[i])
    keys = np.empty((len(starts), 2 * bands), np.uint64)
    for side, signature in enumerate((low, high)):
        for band in range(bands):
            key = np.full(len(starts), 2 * band + side + 1, np.uint64)
            for row in signature[band * o.rows : (band + 1) * o.rows]:
                key = mixed(key * MIX2 + row)
            keys[:, 2 * band + side] = key
    return keys.view(np.int64)


def banded(texts: DataFrame, o: MinMaxOptions) -> DataFrame:
    """``id, band_key``: texts (``id``, ``text``) under each of their keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("id").to_numpy(), batch.column("text").to_pylist()
            start = 0
            while start < len(held):  # pieces of about 64 thousand characters stay in the cache
                end, size = start, 0
                while end < len(held) and (size < 65_536 or end == start):
                    size += len(held[end])
                    end += 1
                keys = band_keys(*substring_hashes(held[start:end], o.width), o)
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[start:end]), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], ["id", "keys"])
                start = end

    signed = texts.select("id", "text").mapInArrow(sign, "id long, keys array<long>")
    return signed.select("id", F.explode("keys").alias("band_key"))


def similarity(width: int):
    """Exact similarity of two texts as a column function (Arrow batches)."""

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p = {x[i : i + width] for i in range(len(x) - width + 1)}
            q = {y[i : i + width] for i in range(len(y) - width + 1)}
            both = len(p & q)
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out)

    return exact


def hot_bands(texts: DataFrame, o: MinMaxOptions) -> DataFrame:
    """``band_key`` of the bands that many texts share."""
    sample = texts.filter(F.pmod(F.xxhash64("t1", F.lit(o.seed)), F.lit(o.hot_sample)) == 0)
    counted = banded(sample, o).groupBy("band_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 16")
    total = sample.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).filter(F.col("n") * o.hot_share > F.col("total")).select("band_key")


def similar_texts(texts: DataFrame, o: MinMaxOptions) -> DataFrame:
    """``a1, a2, b1, b2, similarity`` of different texts at or above the threshold.

    ``texts`` holds ``t1, t2, id, text``, each text once and of at least ``width``
    characters.
    """
    hot = kept(hot_bands(texts, o), "hot")
    flagged = banded(texts, o).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "band_key", "left")  # bounded by hot_share
    block = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(F.lit(0))
    met = flagged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band_key", block))).filter("n > 1 or hot").select("band_key", "id")
    met = kept(met, "bands")
    pairs = split_pairs(met, ["band_key"], "id", hot).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")
    scored = joined.withColumn("similarity", similarity(o.width)("text_a", "text_b"))
    return scored.filter(F.col("similarity") >= o.threshold).select("a1", "a2", "b1", "b2", "similarity")


def prepared(rows: DataFrame, key: str, text: str, at: str, o: MinMaxOptions) -> tuple[DataFrame, DataFrame]:
    """Current keys with the fingerprint of their text (128 bits), and each text once.

    The 64-bit ``id`` of a text is the first half of its fingerprint, of the texts
    that share one but the first a hash of both halves."""
    marked = rows.select(key, at, F.col(text).alias("text"), F.length(text).alias("size"), *fingerprint(F.col(text), "t"))
    keys = current_keys(marked, key, ["t1", "t2", "size"], at).filter(F.col("size") >= o.width)
    keys = keys.select(F.col(key).alias("key"), "t1", "t2")
    texts = marked.filter(F.col("size") >= o.width).select("t1", "t2", "text").repartition("t1").dropDuplicates(["t1", "t2"])
    place = F.row_number().over(Window.partitionBy("t1").orderBy("t2"))
    return keys, texts.withColumn("id", F.when(place == 1, F.col("t1")).otherwise(F.xxhash64("t1", "t2")))


def copies(keys: DataFrame, o: MinMaxOptions) -> DataFrame:
    """``key, t1, t2, n, first``: the keys whose text others have too, how many, and the first of them."""
    sizes = keys.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1")
    return split_join(keys, sizes, ["t1", "t2"], ["key"])


def copy_groups(rows: DataFrame, key: str, text: str, at: str, o: MinMaxOptions = MinMaxOptions()) -> DataFrame:
    """``representative, member, copies, expanded``: each further key of a text, with the text's first
    one; ``expanded`` tells whether the pairs of the group all come out of ``near_duplicates``."""
    held = copies(prepared(rows, key, text, at, o)[0], o).filter("key != first")
    expanded = F.lit(True) if o.expand is None else F.col("n") <= o.expand
    return held.select(F.col("first").alias("representative"), F.col("key").alias("member"), F.col("n").alias("copies"), expanded.alias("expanded"))


def near_duplicates(rows: DataFrame, key: str, text: str, at: str, o: MinMaxOptions = MinMaxOptions()) -> DataFrame:
    """Pairs ``a < b`` of keys whose texts have at least the threshold's similarity.

    Current rows only, each key once.  Null texts and texts shorter than
    ``width`` have no substrings and take no part; equal texts have similarity 1
    (see ``MinMaxOptions.expand`` for large groups of them, whose members
    ``copy_groups`` lists); very long texts are compared whole.  Other columns are
    ignored.
    """
    keys, texts = prepared(rows, key, text, at, o)
    links = similar_texts(texts, o)
    several = copies(keys, o)
    fits = F.lit(True) if o.expand is None else F.col("n") <= o.expand
    few = several.filter(fits)
    pairs = split_pairs(few.select("t1", "t2", "key"), ["t1", "t2"], "key").select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    starred = several.filter(~fits & (F.col("key") != F.col("first")))
    shown = keys.join(starred.select("key"), "key", "left_anti")
    a = shown.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("key").alias("x"))
    b = shown.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("key").alias("y"))
    across = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.unionByName(pairs).unionByName(starred.select(F.col("first").alias("a"), F.col("key").alias("b")))
