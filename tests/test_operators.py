"""Operators on small frames: nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldra.functions.tokens import estimate
from veldra.operators import access, context, evaluation, fusion, ingest, search, skew, users
from veldra.operators.orphans import orphan_counts, orphans
from veldra.sources.settings import problem, read_values

T = [dt.datetime(2024, 1, day) for day in range(1, 12)]
DOCS = "path string, links_to array<string>, ingested_at timestamp_ntz, target string, late int"
REMOVED = "path string, removed_at timestamp_ntz"
PARTS = "doc_path string, ingested_at timestamp_ntz, at int"


def orphan_tables(spark, docs=(), removals=(), sections=(), chunks=()):
    return (
        spark.createDataFrame(list(docs), DOCS),
        spark.createDataFrame(list(removals), REMOVED),
        spark.createDataFrame(list(sections), "section_id string, " + PARTS),
        spark.createDataFrame(list(chunks), "chunk_id string, " + PARTS),
    )


def test_orphans(spark):
    docs = [
        ("a.md", ["b.md", "b.md", "./b.md#x", "gone.md", "never.md", None, "", "later%2Emd", "back.md"], T[5], "x", 1),
        ("a.md", ["old.md"], T[1], None, None),
        ("b.md", None, T[2], None, None),
        ("b.md", None, T[2], None, None),
        ("gone.md", ["never.md"], T[2], None, None),
        ("later.md", [], T[8], None, None),
        ("back.md", [], T[3], None, None),
        (None, ["never.md"], T[3], None, None),
    ]
    removals = [("gone.md", T[2]), ("gone.md", T[2]), ("back.md", T[2]), ("other.md", T[1])]
    sections = [("s1", "gone.md", T[3], 1), ("s2", None, T[3], 1), ("s3", "", T[3], 1), ("s4", "b.md", T[1], 1), (None, "never.md", T[1], 1)]
    chunks = [("c1", "never.md", T[1], 1), ("c1", "a.md", T[6], 2), ("c2", "a.md", T[1], 1), ("c2", "never.md", T[7], 1), ("c2", "never.md", T[7], 1)]
    cases = orphans(*orphan_tables(spark, docs, removals, sections, chunks), salts=3)
    got = {(r.src_table, r.src_key, r.target, r.late) for r in cases.collect()}
    assert got == {("docs", "a.md", "gone.md", False), ("docs", "a.md", "never.md", False), ("docs", "a.md", "later.md", True), ("sections", "s1", "gone.md", False), ("sections", "s4", "b.md", True), ("chunks", "c2", "never.md", False)}
    assert cases.count() == len(got)
    counts = {(r.src_table, r.month): (r.missing, r.late, r.orphans) for r in orphan_counts(cases).collect()}
    assert counts[("docs", "2024-01")] == (2, 1, 3)


def test_orphans_of_empty_tables(spark):
    assert orphans(*orphan_tables(spark)).count() == 0
    assert orphan_counts(orphans(*orphan_tables(spark))).count() == 0


def test_groups_and_broken_settings(spark):
    directories = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b/c",), ("x/y",), ("e",)], "directory string")
    settings = spark.createDataFrame([("", ["all"], False), ("a", None, True), ("a/b/c", ["hr"], False), ("e", [], False)], "path string, declared_groups array<string>, broken boolean")
    got = {r.directory: (r.groups, r.broken) for r in access.effective_groups(directories, settings).collect()}
    assert got == {"": (["all"], False), "a": ([], True), "a/b": ([], True), "a/b/c": (["hr"], False), "x/y": (["all"], False), "e": ([], False)}
    documents = spark.createDataFrame([("p1", "x/y", None), ("p2", "x/y", ["eng"]), ("p3", "x/y", []), ("p4", "a", ["all"])], "path string, directory string, declared_groups array<string>")
    rows = access.document_groups(documents, access.effective_groups(directories, settings)).collect()
    assert {r.path: r.groups for r in rows} == {"p1": ["all"], "p2": ["eng"], "p3": [], "p4": []}


def test_nobody_reads_what_it_may_not(spark):
    documents = spark.createDataFrame([("d1", ["all"]), ("d2", ["hr"]), ("d3", []), ("d4", ["hr", "hr", "all"])], "path string, groups array<string>")
    who = spark.createDataFrame([("u", ["all"], False), ("h", ["hr"], False), ("n", [], False), ("admin", [], True)], "principal string, groups array<string>, admin boolean")
    hits = spark.createDataFrame([(p, d) for p in ("u", "h", "n", "admin") for d in ("d1", "d2", "d3", "d4")], "principal string, path string")
    got = {(r.principal, r.path) for r in access.readable_hits(hits, documents, who).collect()}
    bad = {(r.principal, r.path) for r in access.unreadable(hits, documents, who).collect()}
    assert bad == {(p, d) for p in ("u", "h", "n", "admin") for d in ("d1", "d2", "d3", "d4")} - got
    assert got == {("u", "d1"), ("u", "d4"), ("h", "d2"), ("h", "d4"), *(("admin", d) for d in ("d1", "d2", "d3", "d4"))}
    assert {r.principal: r.readable for r in access.readers(documents, who).collect()} == {"u": 2, "h": 2, "n": 0, "admin": 4}


def test_fusion(spark):
    schema = "qid int, key string, score double, rank int"
    a = spark.createDataFrame([(1, "a", 9.0, 1), (1, "b", 8.0, 2), (1, "c", 7.0, 3)], schema)
    b = spark.createDataFrame([(1, "c", 9.0, 1), (1, "a", 8.0, 2)], schema)
    assert [r.key for r in fusion.fuse(a, b, "key").orderBy("pos").collect()] == ["a", "c", "b"]
    assert [r.key for r in fusion.fuse(a, b.limit(0), "key").orderBy("pos").collect()] == ["a", "b", "c"]
    scores = spark.createDataFrame([(1, "b", 5.0), (1, "c", 6.0)], "qid int, key string, score double")
    ranked = fusion.reranked(fusion.fuse(a, b, "key"), scores, "key")
    assert [r.key for r in ranked.orderBy("final_pos").collect()] == ["c", "b", "a"]
    assert [r.key for r in fusion.selected(ranked, 8, 5.5).collect()] == ["c"]


def test_neighbours_over_buckets(spark):
    rows = [(f"c{i}", "s", i) for i in (0, 1, 2, 63, 64, 65, 127, 128)] + [("x", None, 1), ("y", "t", 1)]
    got = {(r.chunk_id, r.neighbour_id) for r in fusion.neighbours(spark.createDataFrame(rows, "chunk_id string, section_id string, ordinal int")).collect()}
    pairs = {(0, 1), (1, 2), (63, 64), (64, 65), (127, 128)}
    assert got == {(f"c{a}", f"c{b}") for a, b in pairs} | {(f"c{b}", f"c{a}") for a, b in pairs}


def test_passages_merge_overlaps_and_gaps(spark):
    rows = [("d", "s", 0, "c0", 0, 5, "abcde", True, 1), ("d", "s", 1, "c1", 3, 8, "defgh", False, 1), ("d", "s", 2, "c2", 10, 12, "kl", False, 1), ("d", "s", 5, "c5", 20, 21, "z", False, 2)]
    df = spark.createDataFrame(rows, "doc string, sec string, ordinal int, chunk_id string, char_start long, char_end long, text string, selected boolean, priority int")
    got = context.passages(df, "doc", "sec").collect()
    assert [(r.first_ordinal, r.chunks, r.char_start, r.char_end, r.text) for r in got] == [(0, 3, 0, 12, "abcdefgh\n\nkl")]


def loop_packed(rows, budget):
    """Chunks are taken away one by one, passages merged anew each time."""
    left = list(rows)
    while True:
        total, by_section = 0, {}
        for r in left:
            by_section.setdefault(r["section_id"], []).append(r)
        for members in by_section.values():
            members.sort(key=lambda r: r["ordinal"])
            runs = []
            for r in members:
                if runs and runs[-1][-1]["ordinal"] + 1 == r["ordinal"]:
                    runs[-1].append(r)
                else:
                    runs.append([r])
            for run in runs:
                text, end = None, None
                for r in run:
                    text = r["text"] if end is None else text + (r["text"][end - r["char_start"] :] if r["char_start"] < end else "\n\n" + r["text"])
                    end = max(end or 0, r["char_end"])
                if any(r["selected"] for r in run):
                    total += estimate(text)
        if total <= budget or not left:
            return {r["chunk_id"] for r in left}, total
        left.remove(min(left, key=lambda r: (r["selected"], -r["priority"], r["chunk_id"])))


def test_packing_equals_the_loop(spark):
    rng = random.Random(8)
    words = ["alpha", "be", "中文", "gamma12", "x"]
    rows = []
    for section in range(4):
        body = "".join(rng.choice(words) + rng.choice(["", " ", "。", "-"]) for _ in range(120))
        starts = [min(len(body) - 1, max(0, i * 60 - rng.choice([0, 0, 8, 20]))) for i in range(8)]
        ends = [min(len(body), i * 60 + 60) for i in range(8)]
        chosen = {n: p for p, n in enumerate(rng.sample(range(8), 3))}
        for n in range(8):
            beside = [chosen[m] for m in (n - 1, n + 1) if m in chosen]
            if n in chosen or beside:
                rows.append(dict(qid="q", path="d", section_id=f"s{section}", chunk_id=f"c{section}{n}", ordinal=n, text=body[starts[n] : ends[n]], char_start=starts[n], char_end=ends[n], selected=n in chosen, priority=4 * chosen.get(n, min(beside, default=0)) + section))
    df = spark.createDataFrame(pd.DataFrame(rows))
    for budget in (0, 30, 60, 100, 150, 200, 260, 1000):
        want, total = loop_packed(rows, budget)
        got = context.packed(df, budget).collect()
        assert {r.chunk_id for r in got} == want and {r.total for r in got} <= {total}, budget


def test_pool(spark):
    selected = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "qid string, chunk_id string, priority int")
    beside = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")], "chunk_id string, neighbour_id string")
    assert {(r.chunk_id, r.priority, r.selected) for r in context.pool(selected, beside).collect()} == {("a", 1, False), ("b", 1, True), ("c", 2, True), ("d", 2, False)}


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, v int")
    few = spark.createDataFrame([("hot", "h"), ("k0", "z"), ("no", "n")], "k string, w string")
    assert [r.k for r in skew.hot_keys(rows, ["k"], 100).collect()] == ["hot"]
    got = sorted((r.k, r.v, r.w) for r in skew.split_join(rows, few, ["k"], ["v"], share=100).collect())
    assert got == sorted([("hot", i, "h") for i in range(300) if i % 3] + [("k0", 0, "z")])
    assert skew.split_join(rows, few, ["k"], ["v"], "left", share=100).count() == 301
    pairs = [(r.x, r.y) for r in skew.split_pairs(rows.filter("v < 60"), ["k"], "v", share=10, blocks=4).select(F.col("a.v").alias("x"), F.col("b.v").alias("y")).collect()]
    hot = [i for i in range(60) if i % 3]
    assert sorted(pairs) == [(a, b) for a in hot for b in hot if a < b]


def test_links_and_expansion(spark):
    who = spark.createDataFrame([("u", ["all"], False), ("admin", [], True)], "principal string, groups array<string>, admin boolean")
    documents = spark.createDataFrame([(p, ["all"]) for p in "abcdefg"] + [("x", ["hr"])], "path string, groups array<string>")
    links = spark.createDataFrame([("a", "c"), ("d", "a"), ("b", "c"), ("a", "x"), ("x", "e"), ("a", "b"), ("b", "g")], "src string, dst string")
    sources = spark.createDataFrame([(q, q, p, n) for q in ("u", "admin") for n, p in ((1, "b"), (2, "a"))], "qid string, principal string, path string, pos int")
    got = {(r.qid, r.path): r.via for r in fusion.linked(links, sources, documents, who).collect()}
    assert got == {("u", "c"): ["b", "a"], ("u", "d"): ["a"], ("u", "g"): ["b"], ("admin", "c"): ["b", "a"], ("admin", "d"): ["a"], ("admin", "g"): ["b"], ("admin", "x"): ["a"]}
    ranked = spark.createDataFrame([("u", "u", c, p, r, ch, 1.0) for ch, r, c, p in (("lexical", 1, "b::0", "b"), ("lexical", 2, "a::1", "a"), ("semantic", 7, "c::2", "c"), ("semantic", 5, "c::4", "c"), ("lexical", 6, "c::1", "c"))], "qid string, principal string, chunk_id string, path string, rank int, channel string, score double")
    place = spark.createDataFrame([("a::1", "a"), ("b::0", "b"), ("c::1", "c"), ("c::2", "c"), ("c::4", "c"), ("d::0", "d")], "chunk_id string, path string")
    o = search.SearchOptions(channel_k=2, graph_most=3)
    rows = search.candidates(ranked, links, place, documents, who, o).orderBy("pos").collect()
    # the two best chunks of c by either channel, then the first of d; the slot of g, which has no chunk, is beyond the cap
    assert [(r.chunk_id, r.via) for r in rows] == [("b::0", None), ("a::1", None), ("c::4", ["b", "a"]), ("c::1", ["b", "a"]), ("d::0", ["a"])]
    two = search.candidates(ranked, links, place, documents, who, search.SearchOptions(channel_k=2, graph=False, channels=("lexical",))).collect()
    assert {r.chunk_id for r in two} == {"b::0", "a::1"}
    for wrong in ({"channels": ()}, {"channels": ("other",)}, {"final_k": 0}, {"final_k": 51}):
        with pytest.raises(ValueError):
            search.SearchOptions(**wrong)


def test_variants_and_reports(spark):
    with pytest.raises(ValueError):
        evaluation.chosen_variants(["hybrid", "best"])
    assert list(evaluation.chosen_variants(["hybrid"])) == ["hybrid"] and len(evaluation.chosen_variants()) == 5
    rows = spark.createDataFrame([("lexical", 1.0, 1.0, 0.5, 0, False), ("lexical", None, None, None, 2, True), ("hybrid", 0.5, 1.0, 1.0, 0, False)], "variant string, recall_5 double, recall_10 double, mrr_10 double, leaks int, degraded boolean")
    summed = evaluation.summary(rows)
    got = {r.variant: (r.questions, r.scored, r.recall_5, r.leaks, r.degraded) for r in summed.collect()}
    assert got == {"lexical": (2, 1, 1.0, 2, 1), "hybrid": (1, 1, 0.5, 0, 0)}
    text, code = evaluation.report_text(summed)
    assert code == 1 and "lexical 1" in text.splitlines()[-1] and evaluation.report_text(summed.filter("leaks = 0"))[1] == 0
    shown = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "qid string, path string")
    assert [(r.qid, r.path) for r in evaluation.leaks(shown, shown.filter("qid = 'q' and path = 'b'")).collect()] == [("q", "b")]
    asked = spark.createDataFrame([("q", "u", ["a", "typo"], ["gone"]), ("r", "v", None, None)], "id string, user string, expected_docs array<string>, must_not_docs array<string>")
    assert {(r.id, r.kind, r.path) for r in evaluation.missing_documents(asked, spark.createDataFrame([("a",)], "path string")).collect()} == {("q", "expected_docs", "typo"), ("q", "must_not_docs", "gone")}
    assert evaluation.unknown_users(asked, spark.createDataFrame([("u",)], "principal string")) == ["v"]


def test_thresholds(spark):
    scored = [("a", 0.9, 1, False), ("a", 0.5, 2, True), ("a", None, 3, False), ("b", 0.4, 1, True), ("b", 0.3, 2, False), ("c", 0.2, 1, False)]
    rows = spark.createDataFrame(scored, "qid string, score double, pos int, expected boolean")
    asked = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", True)], "qid string, answerable boolean")
    got = {r.threshold: tuple(r)[1:] for r in evaluation.threshold_sweep(rows, asked, [0.35, 0.45], 8).collect()}
    assert got == {None: (2, 0, 1, 1, 1.0, 3, 2), 0.35: (2, 0, 1, 2, 0.6, 3, 2), 0.45: (1, 1, 2, 2, 0.4, 3, 2)}
    one = {r.threshold: r.hit for r in evaluation.threshold_sweep(rows, asked, [0.35], 1).collect()}
    assert one == {None: 1, 0.35: 1}


def test_report_names_no_document(spark):
    documents = spark.createDataFrame([("secret/plan.md", ["hr"]), ("b.md", []), ("c.md", ["all", "ghost"])], "path string, groups array<string>")
    who = spark.createDataFrame([("u", ["all"], False), ("n", [], False), ("admin", [], True)], "principal string, groups array<string>, admin boolean")
    held = spark.createDataFrame([("all", 1, "u"), ("hr", 1, "")], "grp string, documents int, holders string")
    collections = spark.createDataFrame([(["all"],)], "groups array<string>")
    text = access.report_text(access.readers(documents, who), held, access.warnings(documents, who, collections))
    assert text.splitlines() == ["readers", "  admin: 3", "  n: 0", "  u: 1", "groups", "  all: 1 (u)", "  hr: 1 ()", "warnings", "  admin only: 1", "  no groups: 1", "  unheld group: 2"]


def test_nearest_settings(spark):
    directories = spark.createDataFrame([("a/b",), ("c",)], "directory string")
    settings = spark.createDataFrame([("", "All", ["all"]), ("a", "Named", None)], "path string, name string, declared_groups array<string>")
    got = {r.directory: (r.path, r.name, r.declared_groups) for r in access.nearest_settings(directories, settings).collect()}
    assert got == {"a/b": ("a", "Named", None), "c": ("", "All", ["all"])}


def test_manifest(spark):
    schema = "path string, hash string, content_hash string, groups array<string>"
    old = spark.createDataFrame([("same", "1", "1", ["a"]), ("acl", "1", "1", ["a"]), ("front", "1", "c", ["a"]), ("text", "1", "1", ["a"]), ("gone", "1", "1", ["a"]), ("bad", "1", "1", ["a"])], schema)
    new = spark.createDataFrame([("same", "1", "1", ["a"], None), ("acl", "1", "1", ["b"], None), ("front", "2", "c", ["b"], None), ("text", "2", "2", ["a"], None), ("new", "1", "1", [], None), ("bad", "1", "1", ["a"], "no")], schema + ", problem string")
    got = {r.path: r.status for r in ingest.manifest_diff(old, new).collect()}
    assert got == {"same": "skipped", "acl": "acl-updated", "front": "acl-updated", "text": "updated", "new": "added", "gone": "deleted", "bad": "error"}


def test_percentiles_and_metrics(spark):
    values = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("a", None), ("b", 1.0), ("b", 1.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in evaluation.percentiles(values, "g", "v", 0.5, 0.95).collect()}
    assert got == {"a": (5.0, 9.0), "b": (1.0, 1.0)}
    assert {r.g: r.p50 for r in evaluation.percentiles(values, "g", "v", 0.5, inclusive=True).collect()} == {"a": 4.0, "b": 1.0}
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcdef")], "qid int, d string, rank int")
    expected = spark.createDataFrame([(1, "a"), (1, "f"), (2, "a")], "qid int, d string")
    rows = {r.qid: r for r in evaluation.metrics(ranked, expected, "d").collect()}
    assert (rows[1].recall_5, rows[1].recall_10, rows[1].mrr_10) == (0.5, 1.0, 1.0)
    assert (rows[2].recall_5, rows[2].mrr_10) == (0.0, 0.0)


def test_user_import(spark):
    known = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "username string, groups array<string>")
    listed = spark.createDataFrame([("a", ["y", "x", "x"]), ("b", []), ("d", ["z"])], "username string, groups array<string>")
    assert {r.username: r.action for r in users.import_plan(known, listed).collect()} == {"a": "unchanged", "b": "update", "c": "missing", "d": "create"}
    bad = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), (None, ["x"]), ("e", None)], "username string, groups array<string>")
    assert {r.problem for r in users.problems(bad).collect()} == {"listed twice", "no name", "groups are not a list of names"}


def test_settings_reader():
    assert read_values('{:name "A" :read-groups ["x" "y"]} ; end') == [{":name": "A", ":read-groups": ["x", "y"]}]
    assert read_values("#_ x [1 2.5 nil true sym]") == [[1, 2.5, None, True, "sym"]]
    assert problem(read_values('{:read-groups []}')) is None
    for text in ('{:read-group ["x"]}', "[]", '{:read-groups "x"}', "{} {}", "{:read-groups [:x]}", ""):
        assert problem(read_values(text))
    for text in ("{:a", "{:a}", "]", "{:a 1 :a 2}"):
        with pytest.raises(ValueError):
            read_values(text)


def test_stream_windows(spark, tmp_path):
    from veldra.streaming import traces

    rows = pd.DataFrame({"event_id": range(6), "ts": [dt.datetime(2024, 1, 1, 10, 5 * i) for i in range(6)], "event_type": "a", "value": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    stream = traces.windowed_latency(traces.trace_stream(spark, str(tmp_path / "in"), schema), window="10 minutes")
    traces.drain(stream, str(tmp_path / "state"), lambda df, n: seen.extend(df.collect()), "update")
    assert sum(r.n for r in seen) == 6 and len(seen) == 3
