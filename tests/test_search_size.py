"""What searches over all chunks shuffle, and that keeping the best by blocks loses nothing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veldra.operators import lexical, search, semantic
from veldra.operators.best import Best, enough
from veldra.operators.skew import gathered
from veldra.plans.registry import queries
from veldra.plans.search_queries import parts_of


def shuffled_rows(spark, run):
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > before)


def test_a_search_shuffles_fewer_rows_than_there_are_postings(spark, folder, tmp_path):
    for name in ("chunks", "docs", "collections"):  # a folder of its own, so that the store is made anew
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    postings = lexical.postings(spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "index_text"), "chunk_id", "index_text").count()
    moved = shuffled_rows(spark, lambda: queries()["channel_counts"](spark, str(tmp_path)).collect())
    assert 0 < moved < postings


def test_best_of_blocks_equals_the_ranked_scores(spark):
    words = ["all", "red", "green", "blue", "grey", "鹿港"]
    texts = [(f"d{i:03d}", "all " + " ".join(words[1 + i % 5] for _ in range(1 + i % 3)) + (" red" if i % 7 == 0 else "")) for i in range(120)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(texts, "key string, text string").repartition(3)
    every = df.filter("text <> ''")
    asked = spark.createDataFrame([("a", "red"), ("a", "blue"), ("b", "all"), ("c", "鹿港"), ("c", "all"), ("d", "unknown")], "qid string, term string")
    for source in (df, every):
        want = lexical.top(lexical.scores(lexical.built(source, "key", "text"), "key", asked), "key", 9)
        index = lexical.built_blocks(source, "key", "text")
        assert index.collection.collect() == lexical.built(source, "key", "text").collection.collect()
        for tasks in (None, 3):
            got = lexical.best(index, "key", asked, 9, tasks=tasks)
            assert sorted(map(tuple, got.select("qid", "key", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "key", "score", "rank").collect()))
        assert got.filter("qid = 'b'").select("score").distinct().collect()[0].score == 0.0  # in every document, and found


def test_best_with_ties_and_little_room():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (5, 400)).astype(float)
    scores[rng.random(scores.shape) < 0.1] = -np.inf
    keys = [f"k{i:03d}" for i in rng.permutation(400)]
    for most in (1, 50, 10_000):
        best, rows = Best(7, most), []
        for at in range(0, 400, 40):
            for q in (0, 3):  # two groups of queries
                upto = 3 if q == 0 else 5
                rows += best.add(b"%d" % q, pa.array(range(q, upto)), pa.array(keys[at : at + 40]), scores[q:upto, at : at + 40])
        rows += best.rest()
        found = [r for q, k, s in rows for r in zip(q.to_pylist(), k.to_pylist(), s.to_pylist())]
        for q in range(5):
            want = sorted((-s, k) for s, k in zip(scores[q], keys) if s > -np.inf)[:7]
            assert sorted((-s, k) for n, k, s in found if n == q)[:7] == want


def test_rows_of_a_batch_do_not_grow_with_the_partitions_of_a_shuffle(spark):
    texts = spark.range(20_000, numPartitions=40).selectExpr("concat('d', id) as key", "concat_ws(' ', 'all', repeat('red ', cast(1 + id % 9 as int)), concat('x', id % 50)) as text")
    index = lexical.built_blocks(texts, "key", "text")
    asked = spark.createDataFrame([(f"q{i}", t) for i in range(20) for t in ("red", f"x{i}")], "qid string, term string")
    vectors = spark.range(20_000, numPartitions=40).selectExpr("id", "array(cast(1 as float), cast(sin(id) as float))").toDF("id", "v")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        moved = shuffled_rows(spark, lambda: lexical.best(index, "key", asked, 200, tasks=8).collect())
        near = shuffled_rows(spark, lambda: semantic.nearest(vectors.filter("id % 1000 = 0"), vectors, "id", "v", 200, 2, 8).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    most = 20 * 8 * enough(200, 8)  # queries, parts
    assert moved < most + 2000 and near < most + 2000  # and terms, blocks and questions


def test_best_that_lie_in_one_part_are_all_found(spark):
    texts = spark.range(4000, numPartitions=20).selectExpr("concat('d', lpad(id, 5, '0')) as key", "if(id < 200, concat('red blue ', repeat('red ', cast(id % 3 as int))), if(id % 2 = 0, 'red grey grey grey grey grey', 'grey')) as text")
    asked = spark.createDataFrame([("a", "red"), ("b", "blue"), ("c", "grey")], "qid string, term string")
    want = lexical.top(lexical.scores(lexical.built(texts, "key", "text"), "key", asked), "key", 150)
    got = lexical.best(lexical.built_blocks(texts, "key", "text"), "key", asked, 150, tasks=10)
    rows = lambda df: sorted(map(tuple, df.select("qid", "key", "score", "rank").collect()))
    assert rows(got) == rows(want)
    vectors = spark.range(4000, numPartitions=20).selectExpr("id", "array(if(id < 200, 1.0, 0.1), 1.0 - id / 8000, 0.3)").toDF("id", "v")
    few = vectors.filter("id in (0, 3, 3000)")
    near = lambda tasks: sorted(map(tuple, semantic.nearest(few, vectors, "id", "v", 150, 3, tasks).select("qid", "id", "score", "rank").collect()))
    assert len(near(10)) == 450 and near(10) == near(None)


def test_dropped_rows_stand_behind_a_marked_one():
    rng = np.random.default_rng(5)
    scores, keys = rng.integers(0, 9, (3, 300)).astype(float), [f"k{i:03d}" for i in rng.permutation(300)]
    for most in (1, 40, 10_000):
        best, rows = Best(6, most, marked=True), []
        for at in range(0, 300, 30):
            rows += best.add(b"0", pa.array(range(3)), pa.array(keys[at : at + 30]), scores[:, at : at + 30])
        rows += best.rest()
        found = [r for q, k, s, last in rows for r in zip(q.to_pylist(), s.to_pylist(), k.to_pylist(), last.to_pylist())]
        for q in range(3):
            given, marked = {k for n, s, k, last in found if n == q}, [(-s, k) for n, s, k, last in found if n == q and last]
            assert min(marked) < min((-s, k) for s, k in zip(scores[q], keys) if k not in given)


def test_rows_of_a_batch_do_not_grow_where_spark_cuts_partitions(spark):
    texts = spark.range(24_000, numPartitions=48).selectExpr("concat('d', id) as key", "concat_ws(' ', 'all', repeat('red ', cast(1 + id % 9 as int)), concat('x', id % 50)) as text")
    index = lexical.built_blocks(texts, "key", "text")
    asked = spark.createDataFrame([(f"q{i}", t) for i in range(20) for t in ("red", f"x{i}")], "qid string, term string")
    cut = {"adaptive.enabled": "true", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.0", "shuffle.partitions": "12"}
    old = {c: spark.conf.get(f"spark.sql.{c}") for c in cut}
    for c, value in cut.items():
        spark.conf.set(f"spark.sql.{c}", value)
    try:
        moved = shuffled_rows(spark, lambda: lexical.best(index, "key", asked, 200, tasks=3).collect())
    finally:
        for c, value in old.items():
            spark.conf.set(f"spark.sql.{c}", value)
    assert moved < 20 * 3 * enough(200, 3) + 2000  # questions, parts; terms, blocks and questions


def test_a_part_takes_each_block_once_and_asks_after(spark):
    asked, held = spark.range(7).toDF("a"), spark.range(100, numPartitions=9).selectExpr("id as h")
    rows = gathered(asked, held, "h", 4).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 4 * 7 + 100 and sorted(r.h for r in rows if not r._asks) == list(range(100))
    for part in range(4):
        own = [r for r in rows if r._part == part]
        assert len({r.task for r in own}) == 1 and sorted(r.a for r in own if r._asks) == list(range(7))
        assert [r._asks for r in own] == sorted(r._asks for r in own)


def test_parts_are_as_many_until_they_are_too_large():
    assert [parts_of(n) for n in (0, 20_000, 100_000, 250_000, 1_500_000, 3_000_000)] == [1, 1, 6, 12, 12, 23]


def test_channels_in_one_pass_are_counted_apart(spark):
    raw = spark.createDataFrame([("q", name, f"c{i}", 1.0 / i, i) for name, n in (("lexical", 3), ("semantic", 4)) for i in range(1, n + 1)], "qid string, channel string, chunk_id string, score double, rank int")
    place = spark.createDataFrame([(f"c{i}", "open" if i == 3 else "shut") for i in range(1, 5)], "chunk_id string, path string")
    documents = spark.createDataFrame([("open", ["g"]), ("shut", ["h"])], "path string, groups array<string>")
    principals = spark.createDataFrame([("p", ["g"], False)], "principal string, groups array<string>, admin boolean")
    hits = search.placed(raw, spark.createDataFrame([("q", "p")], "qid string, principal string"), place)
    ranked = search.readable(hits, documents, principals)
    assert sorted((r.channel, r.chunk_id, r.rank) for r in ranked.collect()) == [("lexical", "c3", 1), ("semantic", "c3", 1)]
    got = search.counted(hits, ranked, search.SearchOptions(channel_k=2, overfetch=2)).collect()
    assert sorted(map(tuple, got)) == [("q", "lexical", 3, 1, False), ("q", "semantic", 4, 1, True)]
