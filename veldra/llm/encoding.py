"""Encoding texts with a public byte-level BPE vocabulary inside Spark tasks.

Every text is encoded whole.  Null and empty texts have no ids.  The vocabulary
file is read where the task runs; its folder is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import default_directory, encoder


def vocabulary(name: str = "byte_bpe_50k", directory: str | None = None) -> str:
    """Path of a vocabulary file."""
    return f"{directory or default_directory()}/{name}.tiktoken"


def with_ids(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, ids``: the ids of each row's text."""
    path = path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in batches:
            ids = [one.encode(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for part in ids for i in part), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of ids of a text; 0 for a null or an empty one."""
    path = path or vocabulary()

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = encoder(path)
        for texts in batches:
            yield pa.array(list(map(one.count, texts.to_pylist())), pa.int32())

    return count(text)
