"""Full-text channel: postings, statistics, BM25 ranking.

An index is made once: postings with the length of their document, every file
sorted by term, so that a search reads the row groups of its terms only; the frequency of every
term; the number of documents and their mean length.  Null texts have no postings;
a term that is in every document scores 0 and its documents are still found.  Ties
go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzer import placed_terms, terms
from ..sources.tables import kept
from .best import compared, compared_parts, in_rounds
from .skew import every_salt, gathered, meeting, salt


@dataclass(frozen=True)
class Bm25Options:
    k1: float = 1.2
    b: float = 0.75


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: how often a document holds a term."""
    return texts.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def positions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, position, offset``: terms in their order, with the place in the text (code points
    from 0) of the run that gave them."""
    return texts.select(key, F.posexplode(placed_terms(F.col(text))).alias("position", "t")).select(key, "t.term", "position", "t.offset")


def term_statistics(posted: DataFrame) -> DataFrame:
    """``term, df, occurrences``."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@dataclass(frozen=True)
class Index:
    """``postings``: ``key, term, tf, size``; ``terms``: ``term, df, occurrences``; ``collection``: one
    row, ``n, mean_size``."""

    postings: DataFrame
    terms: DataFrame
    collection: DataFrame


def index_tables(texts: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """The tables of an index over texts of distinct keys, lineage not cut."""
    found = texts.select(key, terms(F.col(text)).alias("terms"))
    # lengths are known where the text lies, so nothing is joined to size the postings
    rows = found.select(key, F.size("terms").cast("long").alias("size"), F.explode("terms").alias("term"))
    sized = rows.groupBy(key, "term", "size").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "size")
    return {"postings": sized.sortWithinPartitions("term", key)}


def completed(tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Adds the statistics of stored postings."""
    posted = tables["postings"]
    lengths = posted.groupBy(key).agg(F.max("size").alias("size"))
    return {**tables, "terms": term_statistics(posted), "collection": lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))}


def built(texts: DataFrame, key: str, text: str) -> Index:
    """An index kept for the session."""
    tables = completed({"postings": kept(index_tables(texts, key, text)["postings"], "postings")}, key)
    return Index(tables["postings"], kept(tables["terms"], "terms"), kept(tables["collection"], "collection"))


def narrowed(index: Index, asked: DataFrame, most: int = 1000) -> Index:
    """The index cut to the asked terms where these are few, so that the files are only read where
    they hold one of them; a larger batch of questions gets the index as it is."""
    held = [r.term for r in asked.select("term").distinct().limit(most + 1).collect()]
    if len(held) > most:
        return index
    wanted = F.col("term").isin(held)
    return Index(index.postings.filter(wanted), index.terms.filter(wanted), index.collection)


def scores(index: Index, key: str, asked: DataFrame, o: Bm25Options = Bm25Options(), salts: int = 16) -> DataFrame:
    """``qid, key, score`` of every document that shares a term with a query.

    ``asked`` holds ``qid, term``, each pair once.  The statistics are those of the
    whole collection, before anybody's permissions.  The few asked terms are copied
    to ``salts`` tasks each, over which the postings of a term are spread, so that a
    term of a third of all documents is no hot key.
    """
    wanted = asked.join(index.terms.select("term", "df"), "term").withColumn("salt", every_salt(salts))
    found = index.postings.withColumn("salt", salt(salts, key)).join(wanted, ["term", "salt"]).crossJoin(index.collection)  # one row
    weight = F.log(F.col("n") / F.col("df")) * F.col("tf") * (o.k1 + 1) / (F.col("tf") + o.k1 * (1 - o.b + o.b * F.col("size") / F.col("mean_size")))
    return found.groupBy("qid", key).agg(F.round(F.sum(weight), 6).alias("score"))


def top(scored: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """The best ``n`` per query with their ``rank``; Catalyst limits each task first."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or (key,)))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


@dataclass(frozen=True)
class BlockIndex:
    """``blocks``: postings of some thousand documents each, packed; ``terms`` and ``collection`` as
    in ``Index``.  For batches of many questions: the postings are scored where they lie
    together, so nothing of their number, or of the number of documents found, is shuffled."""

    blocks: DataFrame
    terms: DataFrame
    collection: DataFrame


def _packed(**lists: pa.Array) -> bytes:
    """Arrays in one compressed buffer."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists.values()], list(lists))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(buffer: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(buffer).read_next_batch()
    return {name: row.column(name).flatten() for name in row.schema.names}


def block_tables(texts: DataFrame, key: str, text: str, size: int = 4096) -> DataFrame:
    """``block, documents, total`` of texts of distinct keys: the documents of each block that have
    terms, and how many terms they have in all.  Nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                spelled = part.column(1).flatten().dictionary_encode()
                pairs = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
                pairs, tf = np.unique(pairs, return_counts=True)
                df = np.bincount(pairs // max(1, len(sizes)), minlength=len(spelled.dictionary))
                block = _packed(keys=part.column(0), sizes=pa.array(sizes), terms=spelled.dictionary, df=pa.array(df), rows=pa.array((pairs % max(1, len(sizes))).astype(np.uint16 if size <= 1 << 16 else np.int64)), tf=pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], ["block", "documents", "total"])

    return texts.select(key, terms(F.col(text)).alias("terms")).mapInArrow(pack, "block binary, documents long, total long")


def _block_terms(blocks: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                held = _unpacked(block.as_py())
                df = held["df"].to_numpy()
                if len(df):
                    occurrences = np.add.reduceat(held["tf"].to_numpy().astype(np.int64), np.cumsum(df) - df)
                    yield pa.RecordBatch.from_arrays([held["terms"], held["df"], pa.array(occurrences)], ["term", "df", "occurrences"])

    found = blocks.select("block").mapInArrow(read, "term string, df long, occurrences long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


def built_blocks(texts: DataFrame, key: str, text: str) -> BlockIndex:
    """An index in blocks kept for the session."""
    blocks = kept(block_tables(texts, key, text), "blocks")
    summed = blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.try_divide(F.sum("total").cast("double"), F.sum("documents")).alias("mean_size"))
    return BlockIndex(blocks, kept(_block_terms(blocks), "terms"), kept(summed, "collection"))


def _scored(asked: dict, held: dict, mean: float, o: Bm25Options) -> np.ndarray:
    """Scores of a block of documents (columns) for a block of questions (rows), of 6 digits; minus
    infinity where they share no term."""
    size, df, row, tf = (held[c].to_numpy() for c in ("sizes", "df", "rows", "tf"))
    ends = np.cumsum(df)
    met = pc.index_in(held["terms"], value_set=asked["terms"])
    # minus zero is a document that was not found: a term that all documents hold adds plus zero
    total = np.full((len(asked["qids"]), len(size)), -0.0)
    long = o.k1 * (1 - o.b + o.b * size / mean)
    for place in np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False)):
        term = met[place].as_py()
        who = asked["who"][asked["starts"][term] : asked["starts"][term + 1]]
        at = slice(ends[place] - df[place], ends[place])
        documents, count = row[at], tf[at]
        weight = asked["idf"][term] * count * (o.k1 + 1) / (count + long[documents])
        if len(who) > 1 and len(documents) * 8 > len(size):
            whole = np.full(len(size), -0.0)
            whole[documents] = weight
            total[who] += whole
        else:
            total[who[:, None], documents] += weight
    lacking = np.signbit(total)
    np.round(total, 6, out=total)
    total[lacking] = -np.inf
    return total


def best(index: BlockIndex, key: str, asked: DataFrame, n: int, o: Bm25Options = Bm25Options(), tasks: int | None = None) -> DataFrame:
    """``qid, key, score, rank`` of the best ``n`` documents that share a term with a query: what
    ``top`` makes of ``scores``.  ``asked``: ``qid, term``, each pair once, ``qid`` a string.

    The blocks are spread over ``tasks`` parts, each of which gives little more than its share of n
    rows per query; over those of a shuffle, which give n rows each, where none is stated.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                words = part.column(1).flatten()
                spelled = words.field("term").dictionary_encode()
                codes = spelled.indices.to_numpy(zero_copy_only=False)
                by_term, idf = np.argsort(codes, kind="stable"), np.zeros(len(spelled.dictionary))
                idf[codes] = words.field("idf").to_numpy(zero_copy_only=False)
                starts = np.searchsorted(codes[by_term], np.arange(len(idf) + 1))
                block = _packed(qids=part.column(0), terms=spelled.dictionary, idf=pa.array(idf), starts=pa.array(starts), who=pa.array(np.repeat(np.arange(len(counts)), counts)[by_term]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), part.column(2).slice(0, 1)], ["asked", "mean_size"])

    def found(asked: DataFrame, per: int) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = (b"", {})

            def score(packed: pa.Scalar, mean: pa.Scalar, block: pa.Scalar) -> tuple:
                nonlocal opened
                packed = packed.as_py()
                if opened[0] != packed:
                    own = _unpacked(packed)
                    opened = packed, own | {c: own[c].to_numpy() for c in ("idf", "starts", "who")}
                own, held = opened[1], _unpacked(block.as_py())
                return packed, own["qids"], held["keys"], _scored(own, held, mean.as_py(), o)

            names = ["qid", key, "score", "last"]
            yield from compared_parts(batches, score, per, 2, names) if tasks else compared(batches, score, per, names)

        known = asked.join(index.terms.select("term", "df"), "term").crossJoin(index.collection)  # one row
        words = known.groupBy("qid", "mean_size").agg(F.collect_list(F.struct("term", F.log(F.col("n") / F.col("df")).alias("idf"))).alias("words"))
        questions = words.select("qid", "words", "mean_size").mapInArrow(pack, "asked binary, mean_size double")
        held = index.blocks.select("block")
        met = gathered(questions, held, "block", tasks) if tasks else meeting(questions, held, "block").select("asked", "mean_size", "block")
        scored = met.mapInArrow(compare, f"qid string, {key} string, score double, last boolean")
        return top(scored, key, n)

    return in_rounds(asked, "qid", found, n, tasks)
