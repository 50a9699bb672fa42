"""Prompts, answers and citations, as columns inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags around thinking, in a pair, without an end, without a start.
THINKING = (r"(?s)<think>.*?</think>", r"(?s)<think>.*\z", r"(?s)\A.*?</think>")
#: White space that is trimmed (no-break spaces are none).
WHITE = r"[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
#: A group of cited numbers in brackets of any width, which is not the text of a link.
CITATION = r"(?U)[\[［【]\s*(\d+(?:\s*[,，、]\s*\d+)*)\s*[\]］】](?!\()"
SEPARATOR = r"(?U)\s*[,，、]\s*"
#: Tags that would end the block of sources.
SOURCES = r"(?i)<(\s*/?\s*sources\s*)>"
#: Answers that say so when nothing was found.
NOT_FOUND = r"找不到|查無|沒有相關|(?i:not found|no relevant|cannot find)"
#: Fixed value: what stands before the question.
QUESTION = "問題："


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII digits they mean."""
    found = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def stripped_thinking(text: Column) -> Column:
    """An answer without thinking: closed pairs, an unclosed one to the end, and all up to
    the first lone closing tag; then trimmed of white space.  Null stays null."""
    for pattern in THINKING:
        text = F.regexp_replace(text, pattern, "")
    return trimmed(text)


def neutral_sources(text: Column) -> Column:
    """Document text whose ``<sources>`` tags cannot end the sources block."""
    return F.regexp_replace(text, SOURCES, "＜$1＞")


def _numbers(group: Column) -> Column:
    """Numbers of one group; one too long to be a number is 0, which cites nothing."""
    return F.transform(F.split(F.translate(group, *_digits()), SEPARATOR), lambda n: F.coalesce(n.try_cast("long"), F.lit(0).cast("long")))


def citation_groups(text: Column) -> Column:
    """The numbers of every citation, in the order of the text, an array for each."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), _numbers)


def citations(text: Column) -> Column:
    """Distinct cited numbers in ascending order."""
    return F.array_sort(F.array_distinct(F.flatten(citation_groups(text))))


def checked_citations(text: Column, passages: Column) -> tuple[Column, Column]:
    """Cited numbers that are passages (1 to their number), and those that are not."""
    found = citations(text)
    good = F.filter(found, lambda n: (n >= 1) & (n <= passages))
    bad = F.filter(found, lambda n: (n < 1) | (n > passages))
    return good, bad


def rewritten(text: Column, passages: Column) -> Column:
    """The text with every citation as ``[n]``, several of one group side by side, and those
    that are no passages left out."""
    kept = lambda group: F.array_join(F.transform(F.filter(group, lambda n: (n >= 1) & (n <= passages)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    between = F.split(text, CITATION, -1)
    cited = F.concat(F.transform(citation_groups(text), kept), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, cited, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def flag(answer: Column, good: Column) -> Column:
    """``empty``; ``uncited``, unless the answer says that nothing was found; else null."""
    blank = trimmed(answer) == ""
    return F.when(blank, "empty").when((F.size(good) == 0) & ~answer.rlike(NOT_FOUND), "uncited")


def sources_block(passages: Column) -> Column:
    """The sources block of a prompt from ``n, title, trail, text`` structs in order; titles,
    trails and texts are all neutralized."""
    shown = lambda part: neutral_sources(F.coalesce(part, F.lit("")))
    entry = lambda p: F.concat(F.lit("["), p["n"].cast("string"), F.lit("] "), shown(p["title"]), F.lit("｜"), shown(p["trail"]), F.lit("\n"), shown(p["text"]))
    return F.concat(F.lit("<sources>\n"), F.array_join(F.transform(passages, entry), "\n\n"), F.lit("\n</sources>"))


def user_message(sources: Column, query: Column) -> Column:
    """Sources and question as the model gets them."""
    return F.concat(sources, F.lit("\n\n" + QUESTION), query)
