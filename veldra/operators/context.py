"""Packing selected chunks into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import batched_estimate


def islands(chunks: DataFrame, *keys: str) -> DataFrame:
    """Adds ``island``: runs of consecutive ordinals within the keys.

    Gaps and islands with one window per document and section; ordinals are
    distinct within it.
    """
    order = Window.partitionBy(*keys).orderBy("ordinal")
    return chunks.withColumn("island", F.col("ordinal") - F.row_number().over(order))


def passages(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row per run that holds a selected chunk: ids, range and merged text.

    The overlap of consecutive chunks is dropped by their offsets; where none
    overlaps a blank line stands between; the pieces are cut by a window and joined
    once, so that a long run costs no more per chunk than a short one.  Runs come
    with the best priority of their selected chunks.
    """
    earlier = Window.partitionBy(*keys, "island").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max("char_end").over(earlier)
    piece = F.when(end.isNull(), F.col("text")).when(F.col("char_start") < end, fresh_part(end)).otherwise(F.concat(F.lit("\n\n"), F.col("text")))
    entry = F.struct("ordinal", "chunk_id", "char_start", "char_end", "piece", "selected")
    runs = islands(chunks, *keys).withColumn("piece", piece).groupBy(*keys, "island").agg(
        F.array_sort(F.collect_list(entry)).alias("parts"),
        F.min(F.when(F.col("selected"), F.col("priority"))).alias("priority"),
        F.bool_or("selected").alias("any_selected"),
    )
    return runs.filter("any_selected").select(
        *keys,
        F.element_at("parts", 1)["ordinal"].alias("first_ordinal"),
        F.size("parts").alias("chunks"),
        F.element_at("parts", 1)["char_start"].alias("char_start"),
        F.array_max(F.transform("parts", lambda p: p["char_end"])).alias("char_end"),
        "priority",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
    )


def fresh_part(end) -> Column:
    """A chunk's text without what lies before ``end``."""
    return F.substring("text", (end - F.col("char_start") + 1).cast("int"), F.length("text"))


#: A run of letters or digits that counts as one, at the end and at the start of a text.
_RUN = r"[\p{L}\p{Nd}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"
#: Characters in which a run that is cut between two chunks is looked for on either side.
LONGEST = 200
LAST_RUN, FIRST_RUN = _RUN + r"\z", r"\A" + _RUN


def pool(selected: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``qid, chunk_id, priority, selected``: the selected chunks (``qid, chunk_id, priority``) and those
    beside them (``chunk_id, neighbour_id``) that are not selected themselves, with the
    best priority of what they stand beside."""
    beside = selected.join(neighbours, "chunk_id").select("qid", F.col("neighbour_id").alias("chunk_id"), "priority", F.lit(False).alias("selected"))
    every = selected.select("qid", "chunk_id", "priority", F.lit(True).alias("selected")).unionByName(beside)
    best = every.groupBy("qid", "chunk_id").agg(F.max("selected").alias("selected"), F.min("priority").alias("any"), F.min(F.when(F.col("selected"), F.col("priority"))).alias("own"))
    return best.select("qid", "chunk_id", F.coalesce("own", "any").alias("priority"), "selected")


def packed(held: DataFrame, budget: int = 6000, sections: tuple[str, ...] = ("path", "section_id")) -> DataFrame:
    """The pool without the chunks that a token budget per query leaves out, with
    ``total``, the tokens of the passages that stay.

    ``held``: ``qid, chunk_id, selected, priority, ordinal, text, char_start, char_end`` and
    the section; a chunk that is not selected stands beside one that is.  While the
    passages together exceed the budget, the weakest neighbour goes first, then the
    weakest selected chunk (of one priority the smaller id).  What stays is therefore
    the longest run from the strong end whose passages fit.  What a chunk adds to
    them depends on its two neighbours in the section only (its overlap with the one
    before it, and that of the one after it, counts once, and so does a word that was
    cut between them), so that two windows find the run without a loop.
    """
    strong = Window.partitionBy("qid").orderBy(F.desc("selected"), "priority", F.desc("chunk_id"))
    placed = held.withColumn("place", F.row_number().over(strong))
    line = Window.partitionBy("qid", *sections).orderBy("ordinal")
    shown = F.struct("ordinal", "char_end", "place", F.length(F.regexp_extract(F.right("text", F.lit(LONGEST)), LAST_RUN, 0)).alias("tail"))
    met = placed.withColumn("before", F.lag(shown).over(line))
    met = met.withColumn("before", F.when(F.col("before.ordinal") == F.col("ordinal") - 1, F.col("before")))
    overlaps = F.coalesce(F.col("char_start") < F.col("before.char_end"), F.lit(False))
    fresh = F.when(overlaps, fresh_part(F.col("before.char_end"))).otherwise(F.col("text"))
    met = met.withColumn("fresh", F.coalesce(fresh, F.lit("")))
    head = F.when(overlaps, F.length(F.regexp_extract(F.left("fresh", F.lit(LONGEST)), FIRST_RUN, 0))).otherwise(F.lit(0))
    words = lambda n: F.when(n > 0, F.ceil(n / 4) + 1).otherwise(F.lit(0))
    joined = F.when((head > 0) & (F.col("before.tail") > 0), words(head + F.col("before.tail")) - words(head) - words(F.col("before.tail"))).otherwise(F.lit(0))
    sized = met.withColumn("whole", F.coalesce(batched_estimate(F.col("text")), F.lit(0))).withColumn("added", F.when(F.col("before").isNotNull(), batched_estimate(F.col("fresh")) + joined).otherwise(F.lit(0)))
    later = sized.withColumn("after", F.lead(F.struct("ordinal", "place", "whole", "added")).over(line))
    own = F.when(F.col("before.place") < F.col("place"), F.col("added")).otherwise(F.col("whole"))
    other = F.when((F.col("after.ordinal") == F.col("ordinal") + 1) & (F.col("after.place") < F.col("place")), F.col("after.added") - F.col("after.whole")).otherwise(F.lit(0))
    running = later.withColumn("total", F.sum(own + other).over(strong.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    last = F.max(F.when(F.col("total") <= budget, F.struct("place", "total"))).over(Window.partitionBy("qid"))
    kept = running.withColumn("last", last).filter(F.col("place") <= F.col("last.place"))
    return kept.withColumn("total", F.col("last.total")).select(*held.columns, "total")
