"""Search terms of a text, as columns inside the JVM.

Compatibility forms are resolved character by character (NFKC), letters made
lower case, and the text cut into runs of ``[a-z0-9]`` (joined by ``- _ . /``
between two of them) and runs of CJK letters.  A joined run gives itself and its
parts of two letters or more, a CJK run its overlapping pairs, a single CJK
letter itself.  Accented Latin letters separate.  A null text has no terms.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ASCII_RUN = r"[a-z0-9]+(?:[-_./][a-z0-9]+)*"
RUNS = ASCII_RUN + r"|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"


def _matters(text: str) -> bool:
    """Whether a resolved form holds something that can be part of a term."""
    return any(c.isascii() and (c.isalnum() or c in "-_./") or 0x2E80 <= ord(c) < 0xD7B0 and c.isalpha() for c in text)


@lru_cache(maxsize=1)
def compatibility_table() -> tuple[str, str, dict[str, str]]:
    """By rule from the Unicode database: characters with one resolved character
    (and these), and characters with several."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and _matters(form):
            (single if len(form) == 1 else several)[chr(code)] = form
    return "".join(single), "".join(single.values()), several


def _ranges(chars: list[str], gap: int = 24) -> str:
    """A short character class that holds the given characters (and some between them)."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


def resolved_forms(text: Column) -> Column:
    """NFKC of each character, as far as it can touch a term."""
    source, target, several = compatibility_table()
    plain = F.translate(text, source, target)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    held = F.array_distinct(F.regexp_extract_all(plain, F.lit(_ranges(list(several))), F.lit(0)))
    return F.aggregate(held, plain, lambda done, char: F.replace(done, char, F.coalesce(F.try_element_at(table, char), char)))


def terms(text: Column) -> Column:
    """Array of terms, in the order of the text."""
    runs = F.regexp_extract_all(F.lower(resolved_forms(text)), F.lit(RUNS), F.lit(0))

    def of_run(run: Column) -> Column:
        parts = F.filter(F.split(run, "[-_./]"), lambda part: F.length(part) >= 2)
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return (
            F.when(run.rlike("^[a-z0-9]+$"), F.array(run))
            .when(run.rlike("^[a-z0-9]"), F.concat(F.array(run), parts))
            .when(F.length(run) == 1, F.array(run))
            .otherwise(pairs)
        )

    return F.flatten(F.transform(runs, of_run))


_RUN = regex.compile(r"([a-z0-9]+(?:[-_./][a-z0-9]+)*)|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+")


def analyzed(text: str | None) -> list[tuple[str, int, int]]:
    """Terms of a text with their position (0, 1, ..) and the offset in the text as it
    stands (code points from 0) of their first character."""
    plain, origin = [], []
    for at, char in enumerate(text or ""):
        form = char if char < "\x80" else unicodedata.normalize("NFKC", char)
        for own in form.lower():
            plain.append(own)
            origin.append(at)
    found: list[tuple[str, int]] = []
    for run in _RUN.finditer("".join(plain)):
        start, end = run.span()
        if run[1] is None:
            found += [(run[0][i : i + 2], start + i) for i in range(max(1, end - start - 1))]
            continue
        found.append((run[0], start))
        if not run[0].isalnum():
            found += [(m[0], start + m.start()) for m in re.finditer(r"[^-_./]{2,}", run[0])]
    return [(term, position, origin[at]) for position, (term, at) in enumerate(found)]


ANALYZED = "array<struct<term: string, position: int, offset: int>>"


def _analyze():
    @F.pandas_udf(ANALYZED)
    def analyze(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"term": a, "position": b, "offset": c} for a, b, c in analyzed(t)])

    return analyze


def placed_terms(text: Column) -> Column:
    """The analysis as a column (Arrow batches), where offsets are asked for; null texts
    have no terms."""
    return _analyze()(text)


def register(spark: SparkSession) -> None:
    """Make the analysis callable in SQL as ``analyze(text)``."""
    spark.udf.register("analyze", _analyze())
