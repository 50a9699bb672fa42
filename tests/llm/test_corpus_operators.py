"""Corpus operators against brute force and round trips, on small frames."""

import base64
import datetime as dt
import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldra.llm import bpe, confusables, encoding, garble, knn, mixing, neardup, splitting
from veldra.llm.queries import queries
from veldra.functions.tokens import estimate

NOW = dt.datetime(2024, 1, 1)


def versioned(spark, rows, kind):
    """Rows of key and value with an older version, a redelivered row and clashing columns."""
    data = [(k, v, NOW, "x", 1) for k, v in rows]
    data += [(k, v, NOW, "x", 1) for k, v in rows[:3]] + [(k, None, NOW - dt.timedelta(1), "y", 2) for k, _ in rows[:5]] + [(None, rows[0][1], NOW, "z", 3)]
    return spark.createDataFrame(data, f"key string, value {kind}, at timestamp_ntz, id string, text2 int")


# --- look-alikes

SAME = [("one", "օne"), ("Water", "Ꮃater"), ("ABC", "ꓮꓐꓚ"), ("Code", "Ⲥode"), ("data", "dаta"), ("INC-12", "ＩＮＣ-12"), ("é", "é"), ("a b", "a b"), ("word", "wo​rd"), ("file", "ﬁle"), ("cop", "сор"), ("TEE", "ΤΕΕ"), ("料", "料"), ("ёж", "ёж")]
APART = [("data", "Data"), ("resume", "résumé"), ("a 1", "a 2"), ("a.", "a,"), ("a\nb", "a b"), ("l", "1"), ("I", "l"), ("–", "-"), ("👨‍🔧", "👨🔧")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    text = "The report of the team: {}."
    assert confusables.consistent(text.format(a)) == confusables.consistent(text.format(b))


@pytest.mark.parametrize("a, b", APART)
def test_other_look(a, b):
    assert confusables.consistent(f"x {a} y") != confusables.consistent(f"x {b} y")


def test_whole_words_follow_their_text():
    assert confusables.consistent("Это сор и мусор") == "Это сор и мусор"
    assert confusables.consistent("the сор is here") == "the cop is here"
    assert confusables.consistent(None) is None and confusables.consistent("") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aсеoрЖяlﬁ ​1-.é́", max_size=30))
def test_form_is_stable(text):
    once = confusables.consistent(text)
    assert confusables.consistent(once) == once


def test_look_alike_pairs(spark):
    from veldra.sources.tables import current_keys

    texts = ["the code", "thе code", "the  code", "The code", "the code", "", None, "x" * 20_000, "х" * 20_000]
    rows = versioned(spark, [(f"c{i}", t) for i, t in enumerate(texts)], "string")
    formed = confusables.with_forms(rows, "value")
    current = current_keys(formed.filter("value is not null"), "key", ["t1", "t2", "f1", "f2"], "at")
    got = {(r.a, r.b) for r in confusables.look_alikes(current, "key", "value").collect()}
    assert got == {("c0", "c1"), ("c1", "c4"), ("c7", "c8")}
    assert confusables.look_alikes(current.limit(0), "key", "value").count() == 0


def test_look_alikes_of_many_copies(spark):
    from veldra.sources.tables import current_keys

    rows = versioned(spark, [(f"c{i:02}", "the code" if i % 3 else "thе code") for i in range(60)], "string")
    current = current_keys(confusables.with_forms(rows, "value").filter("value is not null"), "key", ["t1", "t2", "f1", "f2"], "at")
    got = [(r.a, r.b) for r in confusables.look_alikes(current, "key", "value").collect()]
    want = {(f"c{a:02}", f"c{b:02}") for a in range(60) for b in range(a + 1, 60) if (a % 3 == 0) != (b % 3 == 0)}
    assert set(got) == want and len(got) == len(want)
    few = {(r.a, r.b) for r in confusables.look_alikes(current, "key", "value", expand=25).collect()}
    assert few == {tuple(sorted((f"c{a:02}", "c01"))) for a in range(0, 60, 3)}


def test_forms_keep_chunks_without_time(spark, tmp_path):
    from veldra.llm import queries

    rows = spark.createDataFrame([("a", NOW, "thе"), ("a", NOW, "thе"), ("a", None, "old"), ("b", None, "ﬁle"), ("c", NOW, None)], "chunk_id string, ingested_at timestamp_ntz, index_text string")
    rows.write.parquet(str(tmp_path / "chunks.parquet"))
    assert sorted((r.chunk_id, r.consistent_text) for r in queries.p2_forms(spark, str(tmp_path)).collect()) == [("a", "the"), ("b", "file"), ("c", None)]


# --- nearest vectors


def brute_nearest(vectors, k):
    units = {key: np.asarray(v, float) / np.linalg.norm(v) for key, v in vectors.items()}
    pairs = set()
    for a in units:
        order = sorted((b for b in units if b != a), key=lambda b: (-round(float(units[a] @ units[b]), 5), b))
        pairs |= {tuple(sorted((a, b))) for b in order[:k]}
    return pairs


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    cells = np.array(list(itertools.product(range(side), repeat=2)))
    positions = knn.hilbert(cells, 3)
    assert sorted(positions) == list(range(side * side))
    ordered = cells[np.argsort(positions)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    vectors = {f"k{i:03}": (centres[i % 12] + 0.3 * rng.normal(size=64)) * (1 + i % 4) for i in range(150)}
    vectors |= {f"copy{i}": vectors["k000"] for i in range(9)}
    rows = [(k, [float(x) for x in v]) for k, v in vectors.items()]
    bad = [("n1", None), ("n2", [1.0] * 63), ("n3", [0.0] * 64), ("n4", [float("nan")] + [1.0] * 63), ("n5", [None] + [1.0] * 63), ("n6", [])]
    df = versioned(spark, rows + bad, "array<float>")
    got = {(r.a, r.b) for r in knn.similar_pairs(df, "key", "value", "at", knn.CurveOptions(window=32, block=16)).collect()}
    want = brute_nearest({k: np.float32(v) for k, v in vectors.items()}, 5)
    assert len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98
    assert knn.similar_pairs(df.limit(0), "key", "value", "at").count() == 0
    assert knn.similar_pairs(df.filter("key = 'k001'"), "key", "value", "at").count() == 0


def test_nearest_under_any_partitions(spark, folder):
    """Many small ranges, so that most windows reach over bounds; brute force within the window."""
    rows = spark.read.parquet(f"{folder}/chunks.parquet")
    o = knn.CurveOptions(window=16, range_rows=64, range_sample=4, block=8)
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (2, 37):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({(r.a, r.b) for r in knn.similar_pairs(rows, "chunk_id", "vec", "ingested_at", o).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]
    _, points = knn.distinct_points(rows, "chunk_id", "vec", "ingested_at", o)
    held = {r.id: np.asarray(r.vec, float) for r in points.collect()}
    ids = np.array(sorted(held))
    units = np.array([held[i] / np.linalg.norm(held[i]) for i in ids])
    positions = knn.curve_positions(units.astype(np.float32), o)
    cosines, near = units @ units.T, {i: set() for i in ids}
    for curve in range(o.curves):
        order = np.lexsort((ids, positions[:, curve]))
        for at, i in enumerate(order):
            near[ids[i]].update(ids[order[max(0, at - o.window) : at + o.window + 1]].tolist())
    got = {r.id: [n.id for n in r.nearest] for r in knn.nearest(points, o).collect()}
    place = {i: n for n, i in enumerate(ids)}
    for i in ids:  # at least as near as the best within the window of any curve
        best = sorted((cosines[place[i], place[j]] for j in near[i] if j != i), reverse=True)[:5]
        assert np.all(np.array([cosines[place[i], place[j]] for j in got[i]]) >= np.array(best) - 1e-4)


def test_window_and_bounds():
    assert knn.widened(knn.CurveOptions(), 1000).window == 1024 and knn.widened(knn.CurveOptions(), 4 * 262_144).window == 2048
    bounds = (np.array([5, 5, 9]), np.array([10, 20, 1]))
    assert knn.range_numbers(np.array([4, 5, 5, 5, 9, 9]), np.array([99, 9, 10, 25, 0, 1]), bounds).tolist() == [0, 0, 1, 2, 2, 3]


def test_copies_take_the_smallest_keys(spark):
    rows = [(f"k{i:02}", [1.0] * 64) for i in range(30)]
    df = spark.createDataFrame([(k, v, NOW) for k, v in rows], "key string, value array<float>, at timestamp_ntz")
    got = {(r.a, r.b) for r in knn.similar_pairs(df, "key", "value", "at").collect()}
    assert got == brute_nearest(dict(rows), 5)


# --- splitting


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["Some plain words stand here. ", "中文的句子，在這裡。", "line of code()\n", "x" * 300, "y" * 2500 + " ", " > ", "é, "]), max_size=120).map("".join), st.sampled_from([splitting.INDEX_TEXT, splitting.TRAIL]))
def test_pieces_round_trip(text, o):
    pieces = splitting.split(text, o)
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text
    for start, fresh, end, hard in pieces:
        assert start <= fresh < end or not text
        assert estimate(text[start:end]) <= o.limit
    assert (len(pieces) > 1) == (estimate(text) > o.limit)


def test_an_edit_moves_few_cuts():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "report", "budget", "train"]
    text = " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(900))
    other = text[:2000] + "One more sentence is put in here. " + text[2000:]
    parts = lambda t: {t[f:e] for _, f, e, _ in splitting.split(t, splitting.INDEX_TEXT)}
    assert len(parts(text) - parts(other)) <= 4 < len(parts(text)) // 3


def test_an_edit_without_boundaries_moves_few_cuts():
    rng = random.Random(5)
    for letters in ("abcdefghij", "天地玄黃宇宙洪荒日月"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        other = text[:1000] + "q" + text[1000:]
        parts = lambda t: {t[f:e] for _, f, e, _ in splitting.split(t, splitting.INDEX_TEXT)}
        pieces = splitting.split(text, splitting.INDEX_TEXT)
        assert len(parts(text) - parts(other)) <= 2 < len(pieces) // 4
        assert sum(start < fresh for start, fresh, _, _ in pieces) > len(pieces) // 2


def test_splitting_is_linear():
    text = "A sentence of some plain words is here number. " * 213_000
    start = time.time()
    assert len(splitting.split(text, splitting.INDEX_TEXT)) > 10_000 and time.time() - start < 10


def test_overlap_is_whole_sentences():
    text = " ".join(f"Sentence number {i} is here for the test." for i in range(200))
    pieces = splitting.split(text, splitting.INDEX_TEXT)
    assert not any(hard for *_, hard in pieces)
    for start, fresh, _, _ in pieces[1:]:
        assert text[start:].startswith("Sentence") and 0 < estimate(text[start:fresh]) <= 60
    trail = " > ".join(f"Heading number {i}" for i in range(40))
    for start, fresh, _, _ in splitting.split(trail, splitting.TRAIL)[1:]:
        assert trail[start:fresh].count(" > ") == 1


def test_split_frames(spark):
    long = "A sentence of some words. " * 200
    rows = spark.createDataFrame([("a", long, NOW, 1), ("a", long, NOW, 1), ("a", "short", NOW - dt.timedelta(1), 2), ("b", "short", NOW, 1), ("b", long, NOW - dt.timedelta(1), 2), ("c", None, NOW, 1), (None, long, NOW, 1), ("d", "", NOW, 1)], "chunk_id string, index_text string, ingested_at timestamp_ntz, text int")
    sections = spark.createDataFrame([("s", " > ".join(["Heading of words"] * 30), NOW)], "section_id string, trail string, ingested_at timestamp_ntz")
    got = splitting.split_oversized(rows, sections)
    assert {(r.src_table, r.src_key) for r in got.filter("piece = 1").collect()} == {("chunks", "a"), ("sections", "s")}
    assert splitting.split_oversized(rows.limit(0), sections.limit(0)).count() == 0


# --- near duplicates


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    texts = {}
    for i, text in enumerate(base):
        texts[f"b{i}"] = text
        for j in range(3):
            parts = text.split()
            for _ in range(rng.randrange(1, 8)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts[f"b{i}e{j}"] = " ".join(parts)
    texts |= {"copy1": base[0], "copy2": base[0], "s1": "abcd", "s2": "abcd", "t1": "abcde", "t2": "abcde", "e": "", "n": None, "long": "long text " * 5000}
    rows = versioned(spark, list(texts.items()), "string")
    shingles = {k: {t[i : i + 5] for i in range(len(t) - 4)} for k, t in texts.items() if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if shingles[a] and shingles[b] and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.7}
    found = neardup.near_duplicates(rows, "key", "value", "at")
    got = {(r.a, r.b) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and found.count() == len(got)
    starred = {(r.a, r.b) for r in neardup.near_duplicates(rows, "key", "value", "at", neardup.MinMaxOptions(expand=2)).collect()}
    assert {("b0", "copy1"), ("b0", "copy2")} <= starred and ("copy1", "copy2") not in starred
    assert neardup.near_duplicates(rows.limit(0), "key", "value", "at").count() == 0


def test_hot_bands_and_colliding_ids(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=80)
    texts = {f"h{i:03}": " ".join([*base, rng.choice(words)]) for i in range(90)} | {f"o{i}": " ".join(rng.choices(words, k=60)) for i in range(10)}
    rows = versioned(spark, list(texts.items()), "string")
    shingles = {k: {t[i : i + 5] for i in range(len(t) - 4)} for k, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.7}
    o = neardup.MinMaxOptions(hot_sample=1)
    _, held = neardup.prepared(rows, "key", "value", "at", o)
    assert neardup.hot_bands(held, o).count() > 0
    got = [(r.a, r.b) for r in neardup.near_duplicates(rows, "key", "value", "at", o).collect()]
    assert set(got) == want and len(got) == len(want) > 3000
    fewer = neardup.near_duplicates(rows.filter("key < 'h003' or key like 'o%'"), "key", "value", "at")
    assert {(r.a, r.b) for r in fewer.collect()} == {p for p in want if max(p) < "h003"}


def test_copy_groups(spark):
    rows = versioned(spark, [("a", "same text"), ("b", "same text"), ("c", "same text"), ("d", "other text"), ("e", "abc"), ("f", "abc"), ("g", None)], "string")
    got = {tuple(r) for r in neardup.copy_groups(rows, "key", "value", "at", neardup.MinMaxOptions(expand=2)).collect()}
    assert got == {("a", "b", 3, False), ("a", "c", 3, False)}
    assert neardup.copy_groups(rows.limit(0), "key", "value", "at").count() == 0


# --- encoding


@pytest.fixture(scope="module")
def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    with open(encoding.vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", "hello world", "it's we'll DON'T", "  two  spaces \n\n x\t", "中文字句與標點，。", "a" * 3000, "<|endoftext|>", "ﬁ é é 🧯👨‍🔧", "١٢٣ 456", "x" * 50 + " " * 40, "ab" * 700 + "中" * 500, "  z\r\n"]


def test_ids_equal_the_public_encoder(reference_encoder):
    own = bpe.ByteBpe(encoding.vocabulary())
    for text in TEXTS:
        assert own.encode(text) == reference_encoder(text) and own.count(text) == len(own.encode(text)), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(reference_encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encoder(encoding.vocabulary()).encode(text) == reference_encoder(text)


def test_ids_of_rows(spark, reference_encoder):
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.with_ids(rows, "doc_id", "text").collect()}
    assert got == {i: reference_encoder(t) if t else [] for i, t in enumerate([*TEXTS, None])}
    counts = {r.doc_id: r.n for r in rows.select("doc_id", encoding.token_count(F.col("text")).alias("n")).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}


# --- mixing


def loop_apportion(weights, capacity, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(got)) if got[i] < capacity[i] and weights[i] > 0]
        if not free:
            break
        got[max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment_is_by_highest_quotients(sources, seats):
    weights, capacity = np.array([w for w, _ in sources], float), np.array([c for _, c in sources])
    got = mixing.apportion(weights, capacity, seats)
    want = loop_apportion(weights, capacity, seats)
    assert got.sum() == sum(want) and (got <= capacity).all()
    quotient = lambda g: sorted(w / (2 * k + 1) for w, n in zip(weights, g) for k in range(n))
    assert quotient(got) == pytest.approx(quotient(want))


def test_mix_meets_its_shares(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randrange(1, 60), ["a", "B ", "c", None][min(3, i % 7 // 2)], "x") for i in range(900)] + [(9001, None, "a", "x"), (9002, "", "a", "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, mix_id string")
    targets = spark.createDataFrame([("m", "a", 1.0, 5), ("m", "b", 1.0, 5), ("m", "c", 2.0, 2), ("m", "none", 1.0, 9), ("z", "a", 0.0, 1), ("r", "c", 1.0, 1)], "mix_id string, source string, weight double, max_repeats int")
    sizes = mixing.measured(documents)
    total = sizes.agg(F.sum("tokens")).first()[0]
    chosen, shares = mixing.mixed(sizes, targets, mixing.MixOptions(blocks=500, shard_tokens=3000))
    rows = {(r.mix_id, r.source): r for r in shares.collect()}
    assert abs(sum(r.actual_tokens for (m, _), r in rows.items() if m == "m") - total) < 0.02 * total
    assert rows["m", "a"].actual_share == pytest.approx(rows["m", "b"].actual_share, abs=0.01)
    assert rows["m", "none"].actual_tokens == 0 and rows["z", "a"].actual_tokens == 0
    assert rows["r", "c"].actual_tokens == rows["r", "c"].source_tokens
    got = chosen.collect()
    assert all(1 <= r.repeats <= {"a": 5, "b": 5, "c": 2}[r.source] for r in got) and {r.doc_id for r in got}.isdisjoint({9001, 9002})
    assert len({(r.mix_id, r.doc_id) for r in got}) == len(got)
    again = {(r.mix_id, r.doc_id, r.repeats) for r in mixing.mixed(sizes, targets, mixing.MixOptions(blocks=500, shard_tokens=3000))[0].collect()}
    assert again == {(r.mix_id, r.doc_id, r.repeats) for r in got}
    empty, none = mixing.mixed(sizes.limit(0), targets)
    assert empty.count() == 0 and {r.actual_tokens for r in none.collect()} == {0}


def test_shares_meet_quotas_and_targets(spark, folder):
    """The given mixes, all of which some cap binds, against their quotas; and a mix that no cap
    binds against its targets: off by half a document and a block at most."""
    sizes = mixing.measured(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text"))
    longest = {r.source: r.most for r in sizes.groupBy("source").agg(F.max("tokens").alias("most")).collect()}
    _, shares = mixing.mixed(sizes, spark.read.parquet(f"{folder}/mix_targets.parquet"))
    for r in shares.collect():
        assert r.actual_tokens <= r.max_repeats * r.source_tokens
        assert abs(r.actual_tokens - r.quota_blocks * r.block) <= longest.get(r.source, 0) / 2 + 2 * r.block
    most = [r.source for r in sizes.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "source").limit(4).collect()]
    free = spark.createDataFrame([("m", s, w, 50) for s, w in zip(most, (4.0, 3.0, 2.0, 1.0))], "mix_id string, source string, weight double, max_repeats int")
    rows = mixing.mixed(sizes, free)[1].collect()
    assert len(rows) == 4
    for r in rows:
        assert not r.capped and abs(r.actual_tokens - r.target_tokens) <= longest[r.source] / 2 + 2 * r.block
    twice = spark.createDataFrame([("m", "A", 1.0, 2), ("m", " a ", 2.0, 1), ("m", "b", 3.0, 2), ("m", "b", 3.0, 2)], "mix_id string, source string, weight double, max_repeats int")
    got = {r.source: (r.weight, r.max_repeats) for r in mixing.mixed(sizes, twice)[1].collect()}
    assert got == {"a": (3.0, 2), "b": (3.0, 2)}


# --- garbled text

SOUND = ["Die Gebäudeplanung übergibt den Dienstplan nach der jährlichen Übung.", "¿Ñandú? ÁÉÍÓÚÜ º ª", "Þórður Ð ð Æ Ø å", "├── a\n│   └── b\n╔══╗ ÷ ± § © ® ™ £ ¥", "Сверка остатков трёх складов — в начале квартала.", "銘昀專案：值班組長撤回到職資料袋，並由倉管窗口覆核！", "Ａｌｌ ｗｉｄｅ", "e´ café", "shows `â€™` and `Ã¼` and `�`", "manutenção FUNÇÕES EXCEÇÕES", "prіnt lοok", "", "25 °C, 3 m², № 5, “quoted” 🧯"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert not garble.damaged(text) and garble.restored(text) == text


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp437", "mac_roman", "cp850", "cp1251"])
@pytest.mark.parametrize("text", ["Die Gebäudeplanung übergibt den Dienstplan – heute.", "L’équipe répare l’entrepôt à Genève.", "值班組長撤回到職資料袋"])
def test_utf8_read_as_another(codec, text):
    try:
        bad = text.encode().decode(codec)
    except UnicodeDecodeError:
        pytest.skip("not readable in it")
    assert garble.damaged(bad) and garble.restored(bad) == text


def test_other_damage():
    twice = "Übergröße für die Küche".encode().decode("cp1252").encode().decode("cp1252")
    assert garble.restored(twice) == "Übergröße für die Küche"
    assert garble.restored("Сверка остатков".encode("koi8_r").decode("cp1251")) == "Сверка остатков"
    assert garble.restored("每月第一個週二，夜班同仁分批歸檔".encode("big5").decode("latin-1")).startswith("每月第一個週二")
    assert garble.damaged("r�f�rent") and not garble.damaged("It is done. ??\n") and not garble.damaged("Why? Who?")
    part = "All is well here. " + "für die Küche".encode().decode("latin-1") + " and on."
    assert garble.restored(part) == "All is well here. für die Küche and on."


ESCAPED = [("Caf&eacute; and Gar&ccedil;on", "Café and Garçon"), ("Caf=C3=A9 menu =C3=A9t=C3=A9", "Café menu été"), ("na\\u00efve", "naïve"), ("caf&Atilde;&copy;", "café"), ("F&#252;r &#x4e2d;&#x6587;", "Für 中文")]


@pytest.mark.parametrize("bad, text", ESCAPED)
def test_escapes(bad, text):
    assert garble.damaged(bad) and garble.restored(bad) == text
    assert not garble.damaged(f"`{bad}`")


@pytest.mark.parametrize("text", ["AT&amp;T and Q&amp;A and R&amp;D", "Use &lt;div&gt; in the template.", "a &nbsp; b &mdash; c &copy; 2020", "x=10 a=BB c==D &c; \\user"])
def test_sound_escapes(text):
    assert not garble.damaged(text) and garble.restored(text) == text


def test_planted_damage_comes_back(folder):
    """Whole documents and single sentences, over pairs of encodings."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist() if t and not t.isascii() and not garble.damaged(t) and "`" not in t]
    tried = found = back = 0
    for text in texts:
        for true, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp1251")):
            try:
                bad = text.encode(true).decode(read)
            except UnicodeError:
                continue
            if bad != text:
                tried, found = tried + 1, found + garble.damaged(bad)
                got = garble.restored(bad)
                back += sum(a == b for a, b in zip(got.split(), text.split())) >= 0.98 * len(text.split())
    assert tried > 100 and found >= 0.97 * tried and back >= 0.9 * tried, (tried, found, back)


MARKED = [("It isnít so.", "It isn’t so."), ("x ìquotedî, y", "x “quoted”, y"), ("25 ∞C and 3 ░F", "25 °C and 3 °F"), ("one ó two", "one — two"), ("die Lˆschfristen", "die Löschfristen"), ("a ¡ª b", "a — b")]


@pytest.mark.parametrize("bad, text", MARKED)
def test_marks_read_byte_by_byte(bad, text):
    assert garble.damaged(bad) and garble.restored(bad) == text


EAST_ASIAN = ["会议室预订请提前两天提交", "请在系统中提交报销单据", "財務部門在三個工作日內完成", "サーバーは夜間に起動", "総務部に提出してください", "시스템에서직접신청", "Сверка остатков трёх складов", "Die Übergröße für die Küche", "L’équipe répare l’entrepôt"]


@pytest.mark.parametrize("text", EAST_ASIAN)
def test_utf8_read_as_gbk(text):
    words = [word.encode().decode("gb18030", "replace") for word in text.split()]
    for bad, word in zip(words, text.split()):
        if "\ufffd" not in bad and bad != word:  # no byte was lost
            assert garble.damaged(bad) and garble.restored(bad) == word
    bad = " ".join(words)
    assert not garble.damaged(text) and garble.damaged(bad)
    kept = sum(c in garble.restored(bad) for c in text)
    assert kept >= 0.8 * len(text)


@pytest.mark.parametrize("text", ["預約系統會在三天內回覆", "值班組長撤回到職資料袋，並由倉管窗口覆核"])
def test_big5_read_as_gbk(text):
    bad = text.encode("big5").decode("gb18030")
    assert garble.damaged(bad) and garble.restored(bad) == text
    assert garble.search(bad, tuple(garble.READ_AS_HAN))[0] == text


def test_garbled_rows(spark):
    rows = spark.createDataFrame([(1, "fÃ¼r", "a"), (1, "fÃ¼r", "a"), (2, None, "b"), (3, "", "c"), (4, "plain", "d"), (5, "x " * 50_000 + "fÃ¼r", "e")], "doc_id long, text string, restored_text string")
    got = garble.garbled(rows).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 5] and {r.restored_text for r in got if r.doc_id == 1} == {"für"}
    assert garble.garbled(rows.limit(0)).count() == 0


def test_p4_found_runs_the_splitter(spark, folder):
    found = queries()["p4_found"](spark, folder)
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
    pieces = queries()["p4_pieces"](spark, folder).groupBy("src_table", "src_key").agg(F.count(F.lit(1)).cast("int").alias("pieces"))
    counted = splitting.cut_oversized(spark.read.parquet(f"{folder}/chunks.parquet"), spark.read.parquet(f"{folder}/sections.parquet"))
    rows = sorted(map(tuple, counted.select("src_table", "src_key", "pieces").collect()))
    assert rows and rows == sorted(map(tuple, pieces.select("src_table", "src_key", "pieces").collect()))
    assert sorted(map(tuple, found.collect())) == [r[:2] for r in rows]
