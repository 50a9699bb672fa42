"""Token estimate without a tokenizer, as a column and as a Python function.

Every Han, Hiragana, Katakana and Hangul character counts 1, every run of other
letters and decimal digits a quarter of its length (rounded up) and 1 more, all
else nothing.  A null text has a null estimate, an empty one 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def estimated_tokens(text: Column) -> Column:
    """The estimate as an expression inside code generation."""
    spaced = F.regexp_replace(text, CJK, " ")
    letters = r"[\p{L}\p{Nd}]"
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(spaced, F.lit(letters + "{1,4}")) + F.regexp_count(spaced, F.lit(letters + "+"))


def may_exceed(text: Column, limit: int) -> Column:
    """False only where the estimate cannot exceed the limit: a character adds at
    most 3 per 2 characters (a lone letter beside CJK), so short texts need no scan."""
    return F.length(text) * 3 + 1 > 2 * limit


RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[[\p{L}\p{Nd}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+", regex.V1)
ONE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def estimate(text: str) -> int:
    """The estimate of a text in Python."""
    total = 0
    for run in RUN.findall(text):
        total += 1 if len(run) == 1 and ONE.match(run) else (len(run) + 3) // 4 + 1
    return total


#: For every code point: 1 CJK letter, 2 other letter or digit, 0 all else; and which pages of 256 are filled in.
_KINDS, _FILLED = np.zeros(0x110000, np.uint8), np.zeros(0x1100, bool)


def kinds(codes: np.ndarray) -> np.ndarray:
    """The kind of each code point; pages are filled in when a text first needs them."""
    used = np.bincount(codes >> 8, minlength=len(_FILLED)) > 0
    for page in np.flatnonzero(used & ~_FILLED):
        chars = "".join(map(chr, range(page << 8, (page + 1) << 8)))
        for pattern, kind in ((r"[\p{L}\p{Nd}]+", 2), (r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+", 1)):
            for match in regex.finditer(pattern, chars):
                _KINDS[(page << 8) + match.start() : (page << 8) + match.end()] = kind
        _FILLED[page] = True
    return _KINDS[codes]


def part_estimates(text: str, edges: np.ndarray) -> np.ndarray:
    """The estimates of the parts of a text between consecutive edges, each by itself."""
    kind = kinds(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    letters = kind == 2
    first, last = letters.copy(), letters.copy()
    first[1:] &= ~letters[:-1]
    last[:-1] &= ~letters[1:]
    inner = edges[(edges > 0) & (edges < len(text))]
    first[inner] |= letters[inner]
    last[inner - 1] |= letters[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    worth = (kind == 1).astype(np.int64)
    worth[starts] += (ends - starts + 4) // 4 + 1
    upto = np.concatenate([[0], np.cumsum(worth)])
    return upto[edges[1:]] - upto[edges[:-1]]


def estimates(texts: list[str]) -> np.ndarray:
    """The estimates of many texts in one pass."""
    return part_estimates("".join(texts), np.cumsum([0, *map(len, texts)]))


def batched_estimate(text: Column) -> Column:
    """The estimate over Arrow batches, several times as fast as the expression on long
    texts, since it looks at each character once; null is null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        counts = estimates(texts.fillna("").tolist())
        return pd.Series(counts, index=texts.index, dtype="Int64").mask(texts.isna())

    return count(text)


def fit(text: str, start: int, end: int, budget: int) -> int:
    """The greatest stop for which ``text[start:stop]`` stays within the budget;
    ``start`` itself where not even one character does."""
    low, high = start, min(end, start + 4 * budget + 4)
    while high < end and estimate(text[start:high]) <= budget:
        high = min(end, start + 2 * (high - start))
    while low < high:  # the estimate grows with the stop
        middle = (low + high + 1) // 2
        if estimate(text[start:middle]) <= budget:
            low = middle
        else:
            high = middle - 1
    return low
