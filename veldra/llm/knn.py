"""The k most similar vectors of every vector, by shifted space-filling curves.

Each of several curves rotates the unit vectors at random, keeps a few
directions, shifts them and numbers the cells by the Hilbert curve.  Every curve
is cut into ranges at sampled bounds (position, then id, so that no position holds
more than its share); Spark sorts the ranges, and within a range every vector is
compared by matrix products with all vectors at most ``window`` positions away.
The last ``window`` rows of a range and the first of the next meet once more, so
that windows do not end at bounds; the nearest of all windows are merged.  Bounds
and windows depend on the vectors only: the result is the same under any number of
partitions.

Positions get denser as a collection grows, so the window grows with the square
root of the number of points above ``dense`` of them.  Recall is measured against
the exact neighbours of a stated query set by ``recall``.

Vectors are carried as 16-bit integers (unit length = 32,767), which moves a
cosine by about 1e-5.  Equal vectors are one point of the curves, so a group of
copies of any size costs one row there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import semantic
from ..operators.skew import split_join
from ..sources.tables import current_keys, kept


@dataclass(frozen=True)
class CurveOptions:
    """``directions * bits`` is at most 62, the bits of a curve position.

    A range holds about ``range_rows`` points, more where there would be more than
    ``most_ranges``, which bounds what the driver holds of them.
    """

    k: int = 5
    dimensions: int = 64
    curves: int = 8
    directions: int = 12
    bits: int = 5
    window: int = 1024
    dense: int = 262_144
    range_rows: int = 32_768
    range_sample: int = 64
    most_ranges: int = 100_000
    block: int = 512
    seed: int = 11


def widened(o: CurveOptions, points: int) -> CurveOptions:
    """The options with the window for so many points."""
    return replace(o, window=max(o.window, math.ceil(o.window * math.sqrt(points / o.dense))))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows), ``bits`` per axis."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(axes)):
            inside = (axes[i] & q) != 0
            swap = np.where(inside, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(inside, low, 0) ^ swap
            axes[i] ^= swap
        q >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    q = top
    while q > 1:
        turn ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    position = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            position = (position << 1) | (((axis ^ turn) >> bit) & 1)
    return position


def curve_frames(o: CurveOptions) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve its directions and its shift in cells."""
    frames = []
    for curve in range(o.curves):
        rng = np.random.default_rng([o.seed, curve])
        turned, _ = np.linalg.qr(rng.normal(size=(o.dimensions, o.dimensions)))
        frames.append((turned[:, : o.directions].astype(np.float32), rng.random(o.directions)))
    return frames


def curve_positions(units: np.ndarray, o: CurveOptions) -> np.ndarray:
    """Positions of unit vectors on each curve; three deviations of a random
    direction (1 / sqrt(dimensions) each) are cut into the cells of an axis."""
    cells = 1 << o.bits
    scale = cells * np.sqrt(o.dimensions) / 6
    out = np.empty((len(units), o.curves), np.int64)
    for curve, (directions, shift) in enumerate(curve_frames(o)):
        at = (units @ directions) * scale + cells / 2 + shift
        out[:, curve] = hilbert(np.clip(at, 0, cells - 1), o.bits)
    return out


def usable(vector: Column, dimensions: int) -> Column:
    """Right length, every element a finite number, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(values.reshape(-1)))


def _units(batch: pa.RecordBatch, o: CurveOptions) -> np.ndarray:
    units = _matrix(batch.column("vec"), o.dimensions).astype(np.float64)
    units /= np.abs(units).max(axis=1, keepdims=True)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    return units


#: Per curve the positions and ids at which a range starts, both in order.
Bounds = list[tuple[np.ndarray, np.ndarray]]


def sampled_bounds(points: DataFrame, o: CurveOptions) -> Bounds:
    """Where each curve is cut, from a sample by hash of the ids (one point in
    ``range_rows / range_sample``), ordered in Spark; ``most_ranges`` bounds at most."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = curve_positions(_units(batch, o).astype(np.float32), o)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(positions)], ["id", "positions"])

    sample = points.filter(F.pmod(F.xxhash64("id", F.lit(o.seed)), F.lit(max(1, o.range_rows // o.range_sample))) == 0)
    marks = sample.select("id", "vec").mapInArrow(place, "id long, positions array<long>").select("id", F.posexplode("positions").alias("curve", "position"))
    order = Window.partitionBy("curve").orderBy("position", "id")
    ranked = marks.withColumn("n", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("curve")))
    step = F.greatest(F.lit(o.range_sample), F.ceil(F.col("total") * o.curves / o.most_ranges))
    chosen = ranked.filter((F.col("n") % step == 0) & (F.col("n") + step <= F.col("total"))).select("curve", "position", "id").collect()
    per_curve = [sorted((r.position, r.id) for r in chosen if r.curve == curve) for curve in range(o.curves)]
    return [(np.array([p for p, _ in cut], np.int64), np.array([i for _, i in cut], np.int64)) for cut in per_curve]


def range_numbers(positions: np.ndarray, ids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds are at or before each (position, id)."""
    marks, owners = bounds
    low, high = np.searchsorted(marks, positions, "left"), np.searchsorted(marks, positions, "right")
    number = low.copy()
    tied = low < high
    for at in np.unique(low[tied]):
        here = tied & (low == at)
        number[here] += np.searchsorted(owners[at : np.searchsorted(marks, marks[at], "right")], ids[here], "right")
    return number


def placed(points: DataFrame, bounds: Bounds, o: CurveOptions) -> DataFrame:
    """``id, small, range, position``: every point on every curve; ranges are numbered
    through all curves."""
    first = np.cumsum([0, *(len(marks) + 1 for marks, _ in bounds)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ids = _units(batch, o), batch.column("id").to_numpy()
            small = np.rint(units * 32767).astype(np.int16)
            positions = curve_positions(units.astype(np.float32), o)
            ranges = np.stack([first[c] + range_numbers(positions[:, c], ids, bounds[c]) for c in range(o.curves)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(small), _lists(ranges), _lists(positions)], ["id", "small", "ranges", "positions"])

    spread = points.select("id", "vec").mapInArrow(place, "id long, small array<short>, ranges array<int>, positions array<long>")
    return spread.select("id", "small", F.explode(F.arrays_zip("ranges", "positions")).alias("at")).select("id", "small", F.col("at.ranges").alias("range"), F.col("at.positions").alias("position"))


def _best(ids: np.ndarray, others: np.ndarray, cosines: np.ndarray, k: int) -> pa.RecordBatch:
    """The k highest cosines of each row; excluded ones are below -1 already."""
    rows = np.arange(len(ids))
    near, values = np.empty((len(rows), k), np.int64), np.empty((len(rows), k), np.float32)
    for i in range(k):
        best = cosines.argmax(axis=1)
        near[:, i], values[:, i] = others[best], cosines[rows, best]
        cosines[rows, best] = -3
    return pa.RecordBatch.from_arrays([pa.array(ids), _lists(near), _lists(values)], ["id", "near", "cosines"])


def _nearest(ids: np.ndarray, units: np.ndarray, start: int, end: int, o: CurveOptions) -> pa.RecordBatch:
    low, high = max(0, start - o.window), min(len(ids), end + o.window)
    cosines = units[start:end] @ units[low:high].T
    rows = np.arange(end - start)
    cosines[rows, rows + start - low] = -2
    return _best(ids[start:end], ids[low:high], cosines, min(o.k, high - low - 1))


def _small_units(batch: pa.RecordBatch, o: CurveOptions) -> np.ndarray:
    return _matrix(batch.column("small"), o.dimensions).astype(np.float32) / np.float32(32767)


NEAR = "id long, near array<long>, cosines array<float>"


def within_ranges(ranged: DataFrame, o: CurveOptions) -> DataFrame:
    """``id, near, cosines``: per curve and point its nearest within the window and the range."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.empty(0, np.int64)
        units = np.empty((0, o.dimensions), np.float32)
        ranges = np.empty(0, np.int32)
        done = 0
        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            ranges = np.concatenate([ranges, batch.column("range").to_numpy()])
            units = np.concatenate([units, _small_units(batch, o)])
            while len(ids):
                stop = int(np.searchsorted(ranges, ranges[0], side="right"))  # end of this range so far
                ended = stop < len(ids)
                ready = stop if ended else stop - o.window
                while done < ready:
                    end = min(done + o.block, ready)
                    if end - done < o.block and not ended:
                        break
                    yield _nearest(ids[:stop], units[:stop], done, end, o)
                    done = end
                cut = stop if ended else max(0, done - o.window)
                ids, units, ranges, done = ids[cut:], units[cut:], ranges[cut:], done - cut
                if not ended:
                    break
        while done < len(ids):
            end = min(done + o.block, len(ids))
            yield _nearest(ids, units, done, end, o)
            done = end

    return ranged.mapInArrow(compare, NEAR)


def across_bounds(ranged: DataFrame, bounds: Bounds, o: CurveOptions) -> DataFrame:
    """``id, near, cosines``: the nearest within the window on the other side of a bound.

    Of each range only the first and the last ``window`` rows go to the group of
    their bound, with their distance to it; a group holds two windows at most.
    """
    lasts = frozenset((np.cumsum([len(marks) + 1 for marks, _ in bounds]) - 1).tolist())

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bound: int, after: bool, ids: np.ndarray, small: np.ndarray) -> pa.RecordBatch:
            steps = np.arange(len(ids)) if after else np.arange(len(ids))[::-1]
            arrays = [pa.array(np.full(len(ids), bound, np.int32)), pa.array(np.full(len(ids), after)), pa.array(steps.astype(np.int32)), pa.array(ids), _lists(small)]
            return pa.RecordBatch.from_arrays(arrays, ["bound", "after", "step", "id", "small"])

        now, head, tail = None, [], None
        for batch in batches:
            ids, ranges, small = batch.column("id").to_numpy(), batch.column("range").to_numpy(), _matrix(batch.column("small"), o.dimensions)
            starts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ids)]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                if ranges[start] != now:
                    if now is not None and now not in lasts:
                        yield out(now, False, *tail)
                    now, seen, tail = int(ranges[start]), 0, (np.empty(0, np.int64), np.empty((0, o.dimensions), np.int16))
                if now - 1 >= 0 and now - 1 not in lasts and seen < o.window:
                    stop = min(end, start + o.window - seen)
                    part = out(now - 1, True, ids[start:stop], small[start:stop])
                    yield part.set_column(2, "step", pa.array(np.arange(seen, seen + stop - start, dtype=np.int32)))
                seen += end - start
                tail = tuple(np.concatenate([kept, more])[-o.window :] for kept, more in zip(tail, (ids[start:end], small[start:end])))
        if now is not None and now not in lasts:
            yield out(now, False, *tail)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            after, step, ids, units = (np.concatenate(parts) for parts in zip(*held))
            sides = [[x[side][np.argsort(step[side])] for x in (step, ids, units)] for side in (~after, after)]
            for (s, i, u), (t, j, v) in (sides, sides[::-1]):
                for at in range(0, len(i) if len(j) else 0, o.block):
                    rows = slice(at, at + o.block)
                    reach = min(len(j), max(0, o.window - at))  # the rest is too far from the first of the block
                    if reach:
                        cosines = u[rows] @ v[:reach].T
                        cosines[s[rows, None] + t[None, :reach] + 1 > o.window] = -2
                        yield _best(i[rows], j[:reach], cosines, min(o.k, reach))

        now, held = None, []
        for batch in batches:
            numbers = batch.column("bound").to_numpy()
            columns = [batch.column("after").to_numpy(zero_copy_only=False), batch.column("step").to_numpy(), batch.column("id").to_numpy(), _small_units(batch, o)]
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(starts, starts[1:]):
                if start < end and numbers[start] != now:
                    if held:
                        yield from meet(held)
                    now, held = numbers[start], []
                if start < end:
                    held.append(tuple(c[start:end] for c in columns))
        if held:
            yield from meet(held)

    rows = ranged.mapInArrow(edges, "bound int, after boolean, step int, id long, small array<short>")
    return rows.repartition("bound").sortWithinPartitions("bound").mapInArrow(compare, NEAR)


def nearest(points: DataFrame, o: CurveOptions = CurveOptions()) -> DataFrame:
    """``id, nearest``: for each point (``id``, ``vec``, no two equal) its k nearest
    as structs ``cosine, id``, best first, ties by id."""
    points = kept(points.select("id", "vec"), "points")
    o = widened(o, points.count())
    bounds = sampled_bounds(points, o)
    places = placed(points, bounds, o)
    ranged = places.repartitionByRange("range").sortWithinPartitions("range", "position", "id").select("id", "range", "small")
    found = within_ranges(ranged, o)
    if any(len(marks) for marks, _ in bounds):
        found = found.unionByName(across_bounds(ranged, bounds, o))
    pairs = F.filter(F.zip_with("near", "cosines", lambda i, c: F.struct((-c).alias("far"), i.alias("id"))), lambda p: p["far"] < 1.5)
    merged = found.select("id", pairs.alias("pairs")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    # a neighbour comes once per window that found it
    first = F.aggregate(
        "pairs",
        F.expr("cast(array() as array<struct<far: float, id: bigint>>)"),
        lambda done, p: F.when((F.size(done) < o.k) & ~F.exists(done, lambda d: d["id"] == p["id"]), F.concat(done, F.array(p))).otherwise(done),
    )
    return merged.select("id", F.transform(first, lambda p: F.struct((-p["far"]).alias("cosine"), p["id"].alias("id"))).alias("nearest"))


def distinct_points(rows: DataFrame, key: str, vector: str, at: str, o: CurveOptions) -> tuple[DataFrame, DataFrame]:
    """Current keys with the id of their vector (``key, id``), and each usable vector once (``id, vec``)."""
    vec = F.col(vector)
    good = usable(vec, o.dimensions)
    held = current_keys(rows.withColumn("_v", F.when(good, F.xxhash64(vec))), key, ["_v"], at).filter(F.col("_v").isNotNull())
    held = held.select(F.col(key).alias("key"), F.col("_v").alias("id"))
    points = rows.filter(good).select(F.xxhash64(vec).alias("id"), vec.alias("vec")).join(held.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return held, points


def recall(rows: DataFrame, key: str, vector: str, at: str, every: int = 50, o: CurveOptions = CurveOptions()) -> DataFrame:
    """``queries, wanted, found, recall``: of the exact k nearest (by matrix products
    against all points) of the points whose id is divisible by ``every``, those found.

    A found neighbour counts if it is at least as near as the k-th exact one, up to the
    precision of the carried vectors."""
    _, points = distinct_points(rows, key, vector, at, o)
    points = kept(points, "points")
    exact = semantic.nearest(points.filter(F.pmod("id", F.lit(every)) == 0), points, "id", "vec", o.k, o.dimensions)
    least = exact.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    near = nearest(points, o).select(F.col("id").alias("qid"), F.transform("nearest", lambda n: n["cosine"]).alias("cosines"))
    met = least.join(near, "qid", "left").withColumn("found", F.coalesce(F.size(F.filter("cosines", lambda c: c >= F.col("least") - 1e-4)), F.lit(0)))
    sums = met.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum(F.least("wanted", "found")), F.lit(0)).alias("found"))
    return sums.withColumn("recall", F.round(F.try_divide("found", "wanted"), 6))


def similar_pairs(rows: DataFrame, key: str, vector: str, at: str, o: CurveOptions = CurveOptions()) -> DataFrame:
    """Pairs ``a < b`` of keys of which one is among the k nearest of the other.

    Current rows only, each key once.  Null, short, long, zero, NaN and infinite
    vectors take no part; equal vectors have cosine 1 and ties go to the smaller
    key; a collection of one has no pairs.  Other columns are ignored.
    """
    held, points = distinct_points(rows, key, vector, at, o)
    # of a group of copies only the first k + 1 keys can be anybody's neighbours
    order = Window.partitionBy("id").orderBy("key")
    firsts = held.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= o.k + 1)
    copies = firsts.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    asked = nearest(points, o).select("id", F.explode("nearest").alias("n")).select("id", F.col("n.cosine").alias("cosine"), F.col("n.id").alias("other"))
    offers = asked.join(copies.select(F.col("id").alias("other"), "keys"), "other").select("id", F.transform("keys", lambda x: F.struct((-F.col("cosine")).alias("far"), x.alias("key"))).alias("offer"))
    ranked = offers.groupBy("id").agg(F.transform(F.array_sort(F.flatten(F.collect_list("offer"))), lambda x: x["key"]).alias("others"))
    near = copies.join(ranked, "id", "left").select("id", F.col("keys").alias("own"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    mine = lambda x: x != F.col("key")
    pairs = split_join(held, near, ["id"], ["key"]).select("key", F.explode(F.slice(F.concat(F.filter("own", mine), "others"), 1, o.k)).alias("other"))
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
