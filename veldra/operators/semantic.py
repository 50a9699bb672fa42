"""Semantic channel: exact nearest vectors of a stated query set, in blocks.

Rows and queries are packed into blocks; every block of queries goes to every
part of the blocks of rows (an equi-join on a part number, nothing is
broadcast), where each pair of blocks is one matrix product and a part keeps the best
per query, so what is shuffled grows with queries and parts.  Null vectors, vectors of
another length and zero vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .best import compared, compared_parts, in_rounds
from .skew import gathered, meeting


def blocks(rows: DataFrame, key: str, vector: str, dimensions: int, size: int, prefix: str) -> DataFrame:
    """Rows packed into matrices of at most ``size`` rows, numbers as wide as they come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = pa.array([part.column(0).to_numpy().tobytes()], pa.binary())
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}vectors"])

    wide = vector if rows.schema[vector].dataType.elementType.typeName() in ("float", "double") else F.col(vector).cast("array<double>").alias(vector)
    return rows.filter(_usable(F.col(vector), dimensions)).select(F.col(key).cast("long"), wide).mapInArrow(pack, f"{prefix}ids binary, {prefix}vectors binary")


def _unit(ids: np.ndarray, vectors: bytes, dimensions: int) -> np.ndarray:
    """Rows of length 1 of a packed matrix."""
    matrix = np.frombuffer(vectors, np.float32 if len(vectors) == 4 * dimensions * len(ids) else np.float64).astype(np.float64).reshape(-1, dimensions)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _usable(vector: Column, dimensions: int) -> Column:
    return F.coalesce((F.size(vector) == dimensions) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column, dimensions: int) -> Column:
    """Cosine of two vectors, of 6 digits; null where one is unusable."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.when(_usable(a, dimensions) & _usable(b, dimensions), F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, dimensions: int = 64, tasks: int | None = None) -> DataFrame:
    """``qid, key, score, rank``: the k rows of the highest cosine per query, itself left out.

    The blocks are spread over ``tasks`` parts, each of which gives little more than its share of k
    rows per query; over those of a shuffle, which give k rows each, where none is stated.
    """
    held = blocks(rows, key, vector, dimensions, 4096, "r")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")

    def found(asked: DataFrame, per: int) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def score(*packed: pa.Scalar) -> tuple:
                q_ids, q_vectors, r_ids, r_vectors = (x.as_buffer() for x in packed)
                asked, held = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                cosines = _unit(asked, q_vectors, dimensions) @ _unit(held, r_vectors, dimensions).T
                np.round(cosines, 6, out=cosines)
                cosines[asked[:, None] == held[None, :]] = -np.inf
                return bytes(q_ids), pa.array(asked), pa.array(held), cosines

            names = ["qid", "key", "score", "last"]
            yield from compared_parts(batches, score, per, 2, names) if tasks else compared(batches, score, per, names)

        packed = blocks(asked, key, vector, dimensions, 512, "q")
        met = gathered(packed, held, "rids", tasks) if tasks else meeting(packed, held, "rids")
        scored = met.mapInArrow(compare, "qid long, key long, score double, last boolean")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    return in_rounds(queries, key, found, k, tasks).withColumnRenamed("key", key)
