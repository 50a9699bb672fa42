"""Splitting oversized texts at natural boundaries, content-defined.

A rolling hash over the characters sets landmarks where its low bits are zero;
each landmark snaps to the nearest natural boundary (line, sentence or heading
end).  A piece ends at the first such boundary between a least and a greatest
size, else at the last boundary before the greatest size, else (no boundary
there at all) at the first landmark past the least size.  As landmarks depend on
the text around them only, an edit moves the cuts of neighbouring pieces and no
others, with boundaries or without; only where the hash gives no landmark either
(one character repeated, say) a piece ends where the size is reached.

Cuts are set on the fresh part of a piece; the overlap (whole sentences or lines
before it, or one heading; parts between landmarks where the cut itself is none of
these, on a closer grid where they are too long) is added in front where it fits
under the limit.  Time is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import batched_estimate, estimate, estimates, fit, may_exceed, part_estimates

PROSE_END = regex.compile(r"[。！？；]\s*|[.!?]\s+|\n\s*")
HEADING_END = regex.compile(r" > ")


@dataclass(frozen=True)
class SplitOptions:
    """Sizes in estimated tokens; a landmark comes every ``2 ** landmark_bits`` characters."""

    limit: int = 500
    least: int = 120
    overlap: int = 60
    overlap_units: int = 1 << 30
    headings: bool = False
    landmark_bits: int = 7
    window: int = 32


INDEX_TEXT = SplitOptions()
TRAIL = SplitOptions(limit=60, least=12, overlap=20, overlap_units=1, headings=True, landmark_bits=4, window=16)


def landmarks(text: str, o: SplitOptions) -> np.ndarray:
    """Positions after which the rolling hash of the last ``window`` characters ends in zero bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spread = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    rolled = spread.copy()
    factor = 1
    for back in range(1, min(o.window, len(codes))):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        rolled[back:] += spread[:-back] * np.uint64(factor)
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64((1 << o.landmark_bits) - 1) == 0) + 1


def _edges(text: str, o: SplitOptions, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a piece may end, whether that is a natural boundary, and the estimates between.

    A unit above the limit is cut at its landmarks as well, of which no two stand
    closer than half the hash's window, and where they leave too much by size.
    """
    ends = np.fromiter((m.end() for m in (HEADING_END if o.headings else PROSE_END).finditer(text)), np.int64)
    natural = np.unique(np.concatenate([[0], ends, [len(text)]]))
    sizes = part_estimates(text, natural)
    large = np.flatnonzero(sizes > o.limit)
    if not len(large):
        return natural, np.ones(len(natural), bool), sizes
    apart = marks[np.concatenate([[True], np.diff(marks) > o.window // 2])] if len(marks) else marks
    unit = np.searchsorted(natural, apart, "right") - 1
    edges = np.union1d(natural, apart[np.isin(unit, large)])
    forced, most = [], o.limit - o.overlap
    held = part_estimates(text, edges)
    for i in np.flatnonzero((held > most) & ((held > o.limit) | ~np.isin(edges[:-1], natural) | ~np.isin(edges[1:], natural))):
        at, end = int(edges[i]), int(edges[i + 1])
        while at < end:
            at = max(at + 1, fit(text, at, end, most))
            forced.append(at)
    edges = np.union1d(edges, np.array(forced, np.int64))
    return edges, np.isin(edges, natural), part_estimates(text, edges)


def _close_start(text: str, fresh: int, fine: np.ndarray, room: int) -> int:
    """The earliest of closer landmarks from which the text up to ``fresh`` fits."""
    near = fine[np.searchsorted(fine, fresh - 4 * room) : np.searchsorted(fine, fresh)].tolist()
    return next((at for at in near if estimate(text[at:fresh]) <= room), fresh)


def split(text: str, o: SplitOptions) -> list[tuple[int, int, int, bool]]:
    """Pieces as ``start, fresh, end, hard``: the piece is ``text[start:end]``, its
    part from ``fresh`` on is new, and ``hard`` tells that no boundary allowed its end."""
    if len(text) * 2 <= o.limit or estimates([text])[0] <= o.limit:
        return [(0, 0, len(text), False)]
    marks = landmarks(text, o)
    at, natural, sizes = _edges(text, o, marks)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    boundaries = np.flatnonzero(natural)
    after = np.searchsorted(at[boundaries], marks).clip(1, len(boundaries) - 1)
    nearer = at[boundaries[after]] - marks < marks - at[boundaries[after - 1]]
    snapped = np.unique(boundaries[np.where(nearer, after, after - 1)])

    def first(places: np.ndarray, low: int, high: int) -> int | None:
        i = int(np.searchsorted(places, low))
        return int(places[i]) if i < len(places) and places[i] <= high else None

    fine = landmarks(text, replace(o, landmark_bits=max(1, o.landmark_bits - 3))) if not natural.all() else marks
    last, unit = len(at) - 1, 0
    found: list[tuple[int, int, int, bool]] = []
    while unit < last:
        size = lambda k: int(upto[k] - upto[unit])  # noqa: E731, B023
        top = int(np.searchsorted(upto, upto[unit] + o.limit - o.overlap, "right")) - 1
        enough = max(unit + 1, int(np.searchsorted(upto, upto[unit] + o.least)))
        end = last if top >= last else first(snapped, enough, top)
        if end is None:
            before = int(np.searchsorted(boundaries, top, "right")) - 1
            end = int(boundaries[before]) if boundaries[before] > unit else None
        if end is None:
            following = int(boundaries[np.searchsorted(boundaries, unit, "right")])
            end = following if size(following) <= o.limit else min(enough, top) if top > unit else unit + 1
        room = min(o.limit if o.headings else o.overlap, o.limit - size(end))
        back = start = unit
        while back > 0 and unit - back < o.overlap_units and upto[unit] - upto[back - 1] <= room and at[back - 1] >= found[-1][0]:
            back -= 1
            if natural[back] or not natural[unit]:
                start = back
        begin = int(at[start])
        if start == unit > 0 and not natural[unit]:
            begin = _close_start(text, begin, fine, min(o.overlap, room))
        found.append((begin, int(at[unit]), int(at[end]), not natural[end]))
        unit = end
    return found


def pieces(items: DataFrame, o: SplitOptions) -> DataFrame:
    """Pieces of ``src_table, src_key, text``; a text within the limit is one piece.

    Columns: ``src_table, src_key, piece, start, fresh, end, hard_cut, tokens,
    text``.  Offsets are code points; the fresh parts joined give the text back.
    Null texts give no piece, an empty text one empty piece.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for table, key, text in zip(batch.src_table, batch.src_key, batch.text):
                cut_at = split(text, o)
                parts = [text[start:end] for start, _, end, _ in cut_at]
                for n, ((start, fresh, end, hard), tokens, part) in enumerate(zip(cut_at, estimates(parts).tolist(), parts)):
                    rows.append((table, key, n, start, fresh, end, hard, tokens, part))
            yield pd.DataFrame(rows, columns=["src_table", "src_key", "piece", "start", "fresh", "end", "hard_cut", "tokens", "text"])

    schema = "src_table string, src_key string, piece int, start long, fresh long, end long, hard_cut boolean, tokens int, text string"
    return items.filter(F.col("text").isNotNull()).select("src_table", "src_key", "text").mapInPandas(cut, schema)


def cut(items: DataFrame, o: SplitOptions) -> DataFrame:
    """``src_table, src_key, pieces``: of ``src_table, src_key, text`` those that the splitter cuts, and
    into how many pieces.  The pieces themselves are not copied."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch[["src_table", "src_key"]].assign(pieces=[len(split(text, o)) for text in batch.text])
            yield found[found.pieces > 1]

    return items.filter(F.col("text").isNotNull()).select("src_table", "src_key", "text").mapInPandas(count, "src_table string, src_key string, pieces int")


def oversized(rows: DataFrame, name: str, key: str, text: str, at: str, limit: int) -> DataFrame:
    """Texts of current rows above the limit as ``src_table, src_key, text``.

    The estimate runs before any shuffle, so only oversized texts are moved, to
    meet the latest time of their key.  Null texts and rows of null key are left
    out; redelivered rows give one item.
    """
    latest = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("src_key")).agg(F.max(at).alias("at"))
    large = rows.filter(may_exceed(F.col(text), limit)).filter(batched_estimate(F.col(text)) > limit)
    large = large.select(F.col(key).alias("src_key"), F.col(at).alias("own_at"), F.col(text).alias("text"))
    met = large.join(latest, "src_key").filter(F.col("own_at").eqNullSafe(F.col("at")))
    return met.dropDuplicates(["src_key"]).select(F.lit(name).alias("src_table"), "src_key", "text")


def all_oversized(chunks: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every oversized ``chunks.index_text`` and every oversized ``sections.trail``."""
    return (
        oversized(chunks, "chunks", "chunk_id", "index_text", "ingested_at", INDEX_TEXT.limit),
        oversized(sections, "sections", "section_id", "trail", "ingested_at", TRAIL.limit),
    )


def cut_oversized(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Every oversized ``chunks.index_text`` and ``sections.trail`` that the splitter cuts, with its number of pieces."""
    texts, trails = all_oversized(chunks, sections)
    return cut(texts, INDEX_TEXT).unionByName(cut(trails, TRAIL))


def split_oversized(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Pieces of every oversized ``chunks.index_text`` and ``sections.trail``."""
    texts, trails = all_oversized(chunks, sections)
    return pieces(texts, INDEX_TEXT).unionByName(pieces(trails, TRAIL))


def checked(cut: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``src_table, src_key, characters, fresh_hash, within, linked``: of each item the length and the
    MD5 of its fresh parts joined, whether every piece is within the limit, and whether
    every piece starts at or before the end of the one before."""
    fresh = F.expr("substring(text, int(fresh - start + 1), int(end - fresh))")
    limit = F.coalesce(*[F.when(F.col("src_table") == name, F.lit(n)) for name, n in limits.items()])
    rows = cut.select("src_table", "src_key", F.struct("piece", fresh.alias("part"), "start", "end").alias("p"), (F.col("tokens") <= limit).alias("within"))
    items = rows.groupBy("src_table", "src_key").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.bool_and("within").alias("within"))
    joined = F.array_join(F.transform("ps", lambda p: p["part"]), "")
    linked = F.forall(F.transform("ps", lambda p, i: (i == 0) | (p["start"] <= F.try_element_at("ps", i)["end"])), lambda x: x)
    return items.select("src_table", "src_key", F.length(joined).cast("long").alias("characters"), F.md5(F.encode(joined, "UTF-8")).alias("fresh_hash"), "within", linked.alias("linked"))
