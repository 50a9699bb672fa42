"""Retrieval evaluation: recall, reciprocal rank, leaks, latency, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import SearchOptions

#: The ways of searching that are compared, in the order of a report.
VARIANTS = {
    "lexical": SearchOptions(channels=("lexical",), rerank=False, graph=False),
    "semantic": SearchOptions(channels=("semantic",), rerank=False, graph=False),
    "hybrid": SearchOptions(rerank=False, graph=False),
    "hybrid+rerank": SearchOptions(graph=False),
    "hybrid+rerank+graph": SearchOptions(),
}


def chosen_variants(names: list[str] | None = None) -> dict[str, SearchOptions]:
    """The variants of these names, all without names; an unknown name is an error."""
    unknown = sorted(set(names or ()) - set(VARIANTS))
    if unknown:
        raise ValueError(f"unknown variants: {', '.join(unknown)}; known are {', '.join(VARIANTS)}")
    return {name: VARIANTS[name] for name in (names or VARIANTS)}


def percentiles(rows: DataFrame, group: str, value: str, *ps: float, margin: float = 0.002, inclusive: bool = False) -> DataFrame:
    """``group, p<..>``: the value at place ``min(n - 1, floor(p * n))`` of the sorted ones;
    ``inclusive``: at ``floor(p * (n - 1))``.

    Exact without sorting a group: a sketch brackets each percentile, what lies
    below the bracket is counted, and only distinct values inside it (about
    ``2 * margin`` of a group) are ranked.  Null values do not count.
    """
    held = rows.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("value"))
    wanted = [x for p in ps for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = held.groupBy(group).agg(F.percentile_approx("value", wanted, 10_000).alias("q"), F.count(F.lit(1)).alias("total"))
    marked = held.join(sketch, group)
    order = Window.partitionBy(group).orderBy("value")
    out = sketch.select(group)
    for i, p in enumerate(ps):
        low, high = F.col("q")[2 * i], F.col("q")[2 * i + 1]
        below = marked.groupBy(group).agg(F.count_if(F.col("value") < low).alias("below"))
        inside = marked.filter((F.col("value") >= low) & (F.col("value") <= high)).groupBy(group, "value", "total").agg(F.count(F.lit(1)).alias("n"))
        at = F.floor(F.lit(p) * (F.col("total") - 1)) if inclusive else F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
        place = at + 1 - F.col("below")
        ranked = inside.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(below, group)
        out = out.join(ranked.filter(F.col("upto") >= place).groupBy(group).agg(F.min("value").alias(f"p{round(p * 100)}")), group)
    return out


def metrics(ranked: DataFrame, expected: DataFrame, key: str, ks: tuple[int, ...] = (5, 10), mrr_k: int = 10) -> DataFrame:
    """``qid, recall_<k>.., mrr``: of queries with expected keys; a query that found none of
    them has 0, one that expects none does not come out."""
    wanted = expected.select("qid", key).distinct()
    met = wanted.join(ranked.select("qid", key, "rank"), ["qid", key], "left")
    share = [(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks]
    first = F.min(F.when(F.col("rank") <= mrr_k, F.col("rank")))
    return met.groupBy("qid").agg(*share, F.coalesce(1 / first, F.lit(0.0)).alias(f"mrr_{mrr_k}"))


def leaks(shown: DataFrame, must_not: DataFrame) -> DataFrame:
    """What was shown (``qid, path``, of candidates and passages, at any place) and must not be."""
    return shown.join(must_not.select("qid", "path").distinct(), ["qid", "path"], "left_semi")


def summary(rows: DataFrame) -> DataFrame:
    """Per ``variant``: questions, those with an expectation, mean measures of these, leaks and
    questions that ran degraded (``recall_5, recall_10, mrr_10, leaks, degraded`` per question)."""
    means = [F.avg(c).alias(c) for c in ("recall_5", "recall_10", "mrr_10")]
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("questions"), F.count("recall_5").alias("scored"), *means, F.sum("leaks").alias("leaks"), F.count_if("degraded").alias("degraded"))


def missing_documents(questions: DataFrame, indexed: DataFrame) -> DataFrame:
    """``id, kind, path`` of expected and of forbidden documents (``id, expected_docs, must_not_docs``)
    that are not in the index: such a question measures nothing."""
    named = [questions.select("id", F.lit(kind).alias("kind"), F.explode(kind).alias("path")) for kind in ("expected_docs", "must_not_docs")]
    return named[0].unionByName(named[1]).join(indexed.select("path"), "path", "left_anti").select("id", "kind", "path")


def unknown_users(questions: DataFrame, principals: DataFrame) -> list[str]:
    """Up to 20 names of users who ask and are no principals: an evaluation stops at them."""
    lost = questions.select(F.col("user").alias("principal")).distinct().join(principals, "principal", "left_anti")
    return [r.principal for r in lost.orderBy("principal").limit(20).collect()]


def report_text(summed: DataFrame) -> tuple[str, int]:
    """The summary as a table, with a warning where questions ran degraded, and the exit
    code: 1 if anything leaked, else 0."""
    held = {r.variant: r for r in summed.collect()}  # a row per variant
    rows = [held[name] for name in VARIANTS if name in held]
    shown = lambda x: "-" if x is None else f"{x:.3f}"
    lines = [f"{'variant':<22} {'recall@5':>9} {'recall@10':>9} {'MRR@10':>8} {'leaks':>6} {'degraded':>9}"]
    lines += [f"{r.variant:<22} {shown(r.recall_5):>9} {shown(r.recall_10):>9} {shown(r.mrr_10):>8} {r.leaks:>6} {r.degraded:>9}" for r in rows]
    degraded = [f"{r.variant} {r.degraded}" for r in rows if r.degraded]
    if degraded:
        lines.append(f"warning: questions ran degraded ({', '.join(degraded)}); these figures are not those of the whole search")
    return "\n".join(lines), int(any(r.leaks for r in rows))


def threshold_sweep(scored: DataFrame, questions: DataFrame, thresholds: list[float], final_k: int = 8) -> DataFrame:
    """What a least score would do to the first ``final_k`` scored candidates of every question.

    ``scored``: ``qid, score, pos, expected``, best first; ``questions``: ``qid, answerable``.  Per
    threshold (null: none): ``hit``, answerable questions that keep an answer; ``lost``, those
    that only keep one without threshold; ``answerable_empty`` and ``control_empty``, questions
    of either kind that keep nothing; ``mean_kept``; ``answerable``, ``control``, how many there are.
    """
    order = Window.partitionBy("qid").orderBy("pos")
    first = scored.filter(F.col("score").isNotNull()).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= final_k)
    levels = F.array(F.lit(None).cast("double"), *[F.lit(float(t)) for t in thresholds])
    passes = F.col("threshold").isNull() | (F.col("score") >= F.col("threshold"))
    per = first.withColumn("threshold", F.explode(levels)).groupBy("qid", "threshold").agg(F.count_if(passes).alias("kept"), F.count_if(passes & F.col("expected")).alias("found"), F.count_if("expected").alias("any"))
    every = questions.withColumn("threshold", F.explode(levels)).alias("q")
    met = every.join(per.alias("p"), (F.col("q.qid") == F.col("p.qid")) & F.col("q.threshold").eqNullSafe(F.col("p.threshold")), "left")
    met = met.select("q.threshold", "answerable", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "found", "any")])
    yes, no = F.col("answerable"), ~F.col("answerable")
    return met.groupBy("threshold").agg(
        F.count_if(yes & (F.col("found") > 0)).alias("hit"),
        F.count_if(yes & (F.col("any") > 0) & (F.col("found") == 0)).alias("lost"),
        F.count_if(yes & (F.col("kept") == 0)).alias("answerable_empty"),
        F.count_if(no & (F.col("kept") == 0)).alias("control_empty"),
        F.round(F.avg("kept"), 6).alias("mean_kept"),
        F.count_if(yes).alias("answerable"),
        F.count_if(no).alias("control"),
    )
