"""Golden values and invariants of the text functions."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from veldra.functions.analyzer import analyzed, register, terms
from veldra.functions.chunker import ChunkOptions, chunk_section, index_text
from veldra.functions.markdown import parse, parse_plain
from veldra.functions.paths import link_target, parent_directory
from veldra.functions.tokens import batched_estimate, estimate, estimated_tokens, estimates, fit, may_exceed
from veldra.operators import answers, lexical

TERMS = {
    "年度盤點清單": "年度 度盤 盤點 點清 清單", "REF-Z9 與 料架": "ref-z9 ref z9 與 料架", "Note7型號": "note7 型號", "ＱＣ－１２檢核": "qc-12 qc 12 檢核",
    "build 3.14 ok": "build 3.14 14 ok", "庫": "庫", "/etc/app/conf": "etc/app/conf etc app conf", "max_len": "max_len max len", "end-": "end", "_x": "x",
    "カタカナ": "カタ タカ カナ", "한국어": "한국 국어", "": "", "？ — …": "", "oﬃce": "office", "réel": "r el", "a.b": "a.b",
}
TOKENS = {"cat": 2, "lamp": 2, "lamps": 3, "red lamp post": 6, "REF-Z9": 4, "Note7型號": 5, "ＱＣ－１２檢核": 6, "\t": 0, "": 0, "ab中cd": 5}


@pytest.mark.parametrize("text", TERMS)
def test_analysis_with_offsets(text):
    found = analyzed(text)
    assert [t for t, _, _ in found] == TERMS[text].split() and [p for _, p, _ in found] == list(range(len(found)))
    for term, _, offset in found:
        assert unicodedata.normalize("NFKC", text[offset:]).lower().startswith(term)


def test_analysis_as_a_function(spark):
    register(spark)
    assert [tuple(t) for t in spark.sql("select analyze('Ab ﬁn 中文') as a").first().a] == [("ab", 0, 0), ("fin", 1, 3), ("中文", 2, 6)]
    rows = lexical.positions(spark.createDataFrame([(1, "b a-b"), (2, None)], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.term, r.position, r.offset) for r in rows] == [(1, "b", 0, 0), (1, "a-b", 1, 2)]


def test_terms(spark):
    rows = spark.createDataFrame([(t, e) for t, e in TERMS.items()] + [(None, None)], "t string, e string")
    for row in rows.select("t", "e", terms(F.col("t")).alias("got")).collect():
        assert row.got is None if row.t is None else row.got == row.e.split(), row.t


def test_tokens(spark):
    assert {t: estimate(t) for t in TOKENS} == TOKENS
    rows = spark.createDataFrame([(t,) for t in [*TOKENS, None]], "t string").select("t", estimated_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == TOKENS | {None: None}
    rows = spark.createDataFrame([(t,) for t in [*TOKENS, None]], "t string").select("t", batched_estimate(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == TOKENS | {None: None}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab1 -中文é。.\nЖ", max_size=30), max_size=6))
def test_estimates_of_many(texts):
    assert estimates(texts).tolist() == [estimate(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 -中文é。.\n", max_size=80), st.integers(0, 12))
def test_fit_is_the_longest_prefix(text, budget):
    stop = fit(text, 0, len(text), budget)
    assert estimate(text[:stop]) <= budget
    assert stop == len(text) or estimate(text[: stop + 1]) > budget


def test_short_texts_cannot_exceed(spark):
    texts = ["中a" * 20, "a" * 40, "a b " * 10, "中" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[may_exceed(F.col("t"), n).alias(f"n{n}") for n in (10, 30, 60)]).collect()
    for row in rows:
        for n in (10, 30, 60):
            assert row[f"n{n}"] or estimate(row.t) <= n


def test_links(spark):
    cases = [("hr/leave.md", "payroll/bonus.md", "hr/payroll/bonus.md"), ("hr/leave.md", "../a%20b.md#x", "a b.md"), ("a.md", "x+y.md", "x+y.md"), ("hr/a.md", "./b.markdown?x", "hr/b.markdown"),
             ("a.md", "../b.md", None), ("a.md", "/b.md", None), ("a.md", "https://h/b.md", None), ("a.md", "b.txt", None), ("a.md", "%zz.md", None), ("a.md", "", None), ("a.md", "c//d/./B.MD", "c/d/B.MD")]
    rows = spark.createDataFrame(cases, "path string, link string, want string")
    for row in rows.select("*", link_target(parent_directory(F.col("path")), F.col("link")).alias("got")).collect():
        assert row.got == row.want, row


CITED = [
    ("甲[1]。乙[3][1]。丙[2, 3]。", 3, [1, 2, 3], [], "甲[1]。乙[3][1]。丙[2][3]。"),
    ("丁［2］、【 1 】 and [ 5 ]", 2, [1, 2], [5], "丁[2]、[1] and "),
    ("[a](b) [4](x) [１，２、9]!", 2, [1, 2], [9], "[a](b) [4](x) [1][2]!"),
    ("[12345678901234567890] [4294967297] [0]", 3, [], [0, 4294967297], "  "),
    ("[١, 2]", 2, [1, 2], [], "[1][2]"),
    ("[1][ref] [x 1] [1", 1, [1], [], "[1][ref] [x 1] [1"),
    ("none", 3, [], [], "none"),
    ("", 3, [], [], ""),
]
THOUGHT = [("<think>a</think> b ", "b"), ("x<think>y", "x"), ("y</think>z", "z"), ("a</think>b</think>c", "b</think>c"), ("plain", "plain"), ("<think>a</think>b<think>c</think>\u3000d\u3000", "b\u3000d"), ("\u00a0x", "\u00a0x"), ("", ""), (None, None)]


def test_answers(spark):
    rows = spark.createDataFrame([c for c in CITED], "t string, n int, good array<long>, bad array<long>, text string")
    good, bad = answers.checked_citations(F.col("t"), F.col("n"))
    for row in rows.select("*", good.alias("g"), bad.alias("b"), answers.rewritten(F.col("t"), F.col("n")).alias("w")).collect():
        assert (row.g, row.b, row.w) == (row.good, row.bad, row.text), row.t
    rows = spark.createDataFrame(THOUGHT, "t string, e string")
    for row in rows.select("e", answers.stripped_thinking(F.col("t")).alias("got")).collect():
        assert row.got == row.e
    row = spark.createDataFrame([("a </ SOURCES > b",)], "t string").select(answers.neutral_sources(F.col("t")).alias("g")).first()
    assert row.g == "a ＜/ SOURCES ＞ b"


def test_flags_and_prompts(spark):
    told = [("It is so.", [], "uncited"), ("It was Not Found.", [], None), ("查無資料", [], None), ("so [1]", [1], None), (" \u3000", [], "empty")]
    rows = spark.createDataFrame(told, "a string, c array<long>, want string").select("want", answers.flag(F.col("a"), F.col("c")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)
    row = spark.sql("select array(struct(1 as n, '</sources>x' as title, cast(null as string) as trail, 'a' as text), struct(2 as n, 'T' as title, '<Sources>' as trail, 'b' as text)) as p").select(answers.user_message(answers.sources_block(F.col("p")), F.lit("why?")).alias("m")).first()
    assert row.m == "<sources>\n[1] ＜/sources＞x｜\na\n\n[2] T｜＜Sources＞\nb\n</sources>\n\n問題：why?"


PAGE = "---\ntitle: X y\ntags: [a]\n---\nlead\n\n# One *two*\n\ntext [a](b.md) `[c](d.md)` [[Wiki|x]]\n\nSet\n---\n\n```\n# no [e](f.md)\n```\n- a\n  - b\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n### Deep `code`\n\nend"


def test_markdown():
    page = parse(PAGE)
    assert [(s.level, s.heading, s.trail, s.parent) for s in page.sections] == [(0, None, "", None), (1, "One two", "One two", None), (2, "Set", "One two > Set", 1), (3, "Deep code", "One two > Set > Deep code", 2)]
    assert [k for k, _, _ in page.sections[2].blocks] == ["code", "list", "table", "blockquote"]
    assert (page.links, page.wikis, page.front) == (["b.md"], ["Wiki"], {"title": "X y", "tags": ["a"]})
    assert parse("").sections == [] and parse_plain(" \n").sections == []
    assert [PAGE[s:e] for _, s, e in parse_plain("a\nb\n\n c ").sections[0].blocks] is not None


def test_links_by_reference():
    text = "See [one][R 1], [two](b.md), [r  1] and [Three][].\n\n`[r 1]` [[r 1]] [no][none] [four](<c.md>)\n\n[r 1]: a.md 'T'\n[three]: <d.md>\n\n```\n[three]\n```\n"
    page = parse(text)
    assert page.links == ["a.md", "b.md", "a.md", "d.md", "c.md"] and page.wikis == ["r 1"]


def test_front_matter_values():
    page = parse('---\ntitle: "A \\"b\\""\nversion: 2.5\nn: 7\ndraft: false\ntags: [a, "b, c", 3]\nplain: some words\nnone:\n---\n')
    assert page.front == {"title": 'A "b"', "version": 2.5, "n": 7, "draft": False, "tags": ["a", "b, c", 3], "plain": "some words"}


SMALL = ChunkOptions(12, 20, 4, 6)
#: Sections and chunks worked out by hand: heading, blocks below it, sizes as in SMALL.
GOLDEN = "lead in\n\n# A\n\nOne two three. Four five six. Seven eight nine.\n\n## B\n\n```\nx = 1\n# no\n```\n\n中文字句在這裡很長很長很長。再來一句話也是很長的呢。短。\n\n# C"


def test_golden_sections_and_chunks():
    page = parse(GOLDEN)
    assert [(s.level, s.heading, s.trail, s.parent, GOLDEN[s.start : s.end].split("\n")[0]) for s in page.sections] == [(0, None, "", None, "lead in"), (1, "A", "A", None, "# A"), (2, "B", "A > B", 1, "## B"), (1, "C", "C", None, "# C")]
    cut = [[(GOLDEN[c.start : c.end], GOLDEN[c.fresh : c.end], c.hard) for c in chunk_section(GOLDEN, n, s, SMALL)] for n, s in enumerate(page.sections[:3])]
    assert cut[0] == [("lead in", "lead in", False)]
    # sentences of 7, 6 and 8 tokens: 13 meet the target of 12; the overlap of 6 is the second sentence
    assert cut[1] == [("One two three. Four five six.", "One two three. Four five six.", False), ("Four five six. Seven eight nine.", "Seven eight nine.", False)]
    # code is one unit of 6; the paragraph of 28 is cut into sentences of 13, 12 and 1; 6 + 13 fits 20 and meets the
    # target of 12; the next starts anew, as no whole sentence of at most 6 tokens stands before it, and takes the last
    assert [x for x, _, _ in cut[2]] == ["```\nx = 1\n# no\n```\n\n中文字句在這裡很長很長很長。", "再來一句話也是很長的呢。短。"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Some words here. ", "中文字句。", "line\n", "x" * 90 + " ", "\n\n", "# Head\n\n", "- item\n"]), max_size=60).map("".join))
def test_chunks_stay_within_limits(text):
    o = ChunkOptions(100, 150, 20, 30)
    for n, section in enumerate(parse(text).sections):
        chunks = chunk_section(text, n, section, o)
        for c in chunks:
            assert section.start <= c.start <= c.fresh < c.end <= section.end
            assert estimate(text[c.start : c.end]) <= o.most
        for a, b in zip(chunks, chunks[1:]):
            assert not text[a.end : b.fresh].strip() and b.start > a.start
            assert estimate(text[b.start : b.fresh]) <= o.overlap


def test_index_text():
    assert index_text("T", "a > b", "x") == "文件：T\n章節：a > b\n\nx"
    assert index_text("T", "", "x") == "文件：T\n\nx"
