"""The best of many scores per query, over blocks that come one after another.

A task that scores blocks of rows against blocks of queries holds ``k`` rows per
query and the least score that still counts, so that what it gives on grows with
the queries and not with the rows it has seen.

Where rows are spread over parts by a hash, the best of all are spread over them too,
and each part needs to give little more than its share (``enough``).  The last row that
a part gave of a query is marked: where it is among the best of all, the part may hold
more of them, and that query is asked once more in full (``in_rounds``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.tables import kept


class Best:
    """The ``k`` highest scores per query of one task; ties go to the smaller key.

    More than ``most`` held rows are given on as they are: whoever ranks the rows
    of all tasks drops what is too much.  ``marked``: what is given has a fourth array, true in the
    ``k``-th row of a query; every row that was dropped stands behind such a row.
    """

    def __init__(self, k: int, most: int = 1_500_000, marked: bool = False):
        self.k, self.most, self.marked, self.held = k, most, marked, 0
        self.groups: dict[bytes, dict] = {}

    def add(self, group: bytes, queries: pa.Array, keys: pa.Array, scores: np.ndarray) -> Iterator[tuple[pa.Array, ...]]:
        """Scores of the queries of a group (rows) and of some keys (columns), minus infinity where
        there is none.  Gives rows only where too many are held."""
        own = self.groups.setdefault(group, {"queries": queries, "least": np.full(len(queries), np.finfo(np.float64).min), "rows": [], "n": 0, "next": 0})
        passing = scores >= own["least"][:, None]
        many = np.flatnonzero(passing.sum(axis=1) > self.k)
        for at in range(0, len(many), 64):  # few at a time, for the copies
            some = many[at : at + 64]
            valued = np.where(passing[some], scores[some], -np.inf)
            passing[some] &= scores[some] >= np.partition(valued, -self.k, axis=1)[:, -self.k][:, None]
        row, column = np.nonzero(passing)
        own["rows"].append(pa.table({"q": pa.array(row.astype(np.int32)), "score": pa.array(scores[row, column]), "key": keys.take(pa.array(column))}))
        own["n"] += len(row)
        self.held += len(row)
        if own["n"] > own["next"]:
            self._cut(own)
        if self.held > self.most:
            yield from self.rest()

    def _cut(self, own: dict) -> None:
        rows = pa.concat_tables(own["rows"]).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")])
        q = rows["q"].to_numpy()[order.to_numpy()]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.take(order.filter(pa.array(place < self.k))).combine_chunks()
        q = rows["q"].to_numpy()
        ends = np.searchsorted(q, np.arange(len(own["queries"])), "right")
        full = np.diff(np.concatenate([[0], ends])) == self.k
        own["least"][full] = np.maximum(own["least"][full], rows["score"].to_numpy()[ends[full] - 1])
        self.held -= own["n"] - len(rows)
        own |= {"rows": [rows], "n": len(rows), "next": 2 * len(rows) + 100_000}

    def rest(self) -> Iterator[tuple[pa.Array, ...]]:
        """``query, key, score`` of all that is held; the least scores stay, as they hold for what follows."""
        for own in self.groups.values():
            if own["n"]:
                self._cut(own)
                rows = own["rows"][0]
                q = rows["q"].to_numpy()
                last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
                for at in range(0, len(rows), 100_000):
                    part = rows.slice(at, 100_000).combine_chunks()
                    q, key, score = (part[c].combine_chunks() for c in ("q", "key", "score"))
                    yield own["queries"].take(q), key, score, *([pa.array(last[at : at + 100_000])] if self.marked else [])
            own |= {"rows": [], "n": 0, "next": 0}
        self.held = 0


def compared(batches: Iterator[pa.RecordBatch], score: Callable, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The best ``k`` per query of a task, in columns ``names``: query, key, score, whether it is the
    ``k``-th.  ``batches``: those of ``meeting``; ``score``: from the columns of a row the group, the
    queries, the keys and their scores."""
    rows = lambda given: (pa.RecordBatch.from_arrays(list(r), names) for r in given)
    best = Best(k, marked=True)
    for batch in batches:
        for i in range(batch.num_rows):
            yield from rows(best.add(*score(*(c[i] for c in batch.columns))))
    yield from rows(best.rest())


def compared_parts(batches: Iterator[pa.RecordBatch], score: Callable, k: int, asked: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """As ``compared``, the best ``k`` per query of every part.  ``batches``: those of ``gathered``, the
    first ``asked`` columns after the two of its own are a query's.  A task holds the rows of one
    part, whose number is bounded, and the queries of one row."""
    rows = lambda given: (pa.RecordBatch.from_arrays(list(r), names) for r in given)
    held, at = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            part, asks, *row = (c[i] for c in batch.columns)
            if part.as_py() != at:
                held, at = [], part.as_py()
            if not asks.as_py():
                held.append(row[asked:])
                continue
            best = Best(k, marked=True)
            for other in held:
                yield from rows(best.add(*score(*row[:asked], *other)))
            yield from rows(best.rest())


def enough(k: int, parts: int) -> int:
    """How many of the best ``k`` one of ``parts`` rarely exceeds, where parts of equal rows differ
    by half: six deviations above its share."""
    share = 1.5 * k / parts
    return min(k, math.ceil(share + 6 * math.sqrt(share) + 8))


def in_rounds(asked: DataFrame, key: str, found: Callable[[DataFrame, int], DataFrame], k: int, parts: int | None) -> DataFrame:
    """The best ``k`` per query, whatever the parts hold, kept.  ``found``: from queries (``key``) and
    the rows that a part gives of each, the ranked ``qid, .., rank, last`` of all parts.  Without
    ``parts`` each gives k rows, and nothing is kept.
    """
    per = enough(k, parts) if parts else k
    first = found(asked, per)
    if not parts:
        return first.drop("last")
    first = kept(first, "best")
    if per == k:
        return first.drop("last")
    short = first.filter("last").select("qid").distinct()
    if short.isEmpty():
        return first.drop("last")
    again = found(asked.join(short.withColumnRenamed("qid", key), key, "left_semi"), k)
    return kept(first.join(short, "qid", "left_anti").unionByName(again).drop("last"), "best")
