"""One consistent form for texts that look the same.

Every token (a run of letters, marks and digits) gets the set of scripts that
each of its characters could belong to, look-alikes included, and these sets are
intersected.  One script left: the token is spelled in it.  Several left (a
whole-script confusable such as ``cop``): it is spelled in the one of them that
the text's resolved tokens use most, Latin on a tie.  None left (a true mix):
each character takes the first script of its class.  All of this depends only on
the classes of the characters, which a look-alike shares with its original, so
two texts that look the same come out equal.  Around it, compatibility forms
are resolved (NFKC), accents composed, invisible characters removed and kinds of
space made plain; case, accents, digits, punctuation and lines stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join, split_pairs
from ..sources.tables import fingerprint, kept

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")
#: Letters that share one shape, by script in the order of ``SCRIPTS`` (dot: none).
SHAPES = """
AАΑ.ᎪꓮⲀ BВΒ.ᏴꓐⲂ CС..ᏟꓚⲤ D...Ꭰꓓ. EЕΕ.Ꭼꓰ. F....ꓝ. GԌ..Ꮐꓖ. HНΗ.ᎻꓧⲎ IІΙ..ꓲⲒ JЈ..Ꭻꓙ. KКΚ.ᏦꓗⲔ L...Ꮮꓡ. MМΜ.ᎷꓟⲘ
N.Ν..ꓠⲚ OОΟՕ.ꓳⲞ PРΡ.ᏢꓑⲢ QԚ..... R...Ꭱꓣ. SЅ.ՏᏚꓢ. TТΤ.ᎢꓔⲦ U..Ս.ꓴ. VѴ..Ꮩꓦ. WԜ..Ꮃꓪ. XХΧ..ꓫⲬ YУΥ.ᎩꓬⲨ Z.Ζ.ᏃꓜⲌ
aаα.... cс....ⲥ dԁ..... eе..... g..ց... hһ.հ... iіι.... jј.յ... n..ո... oоοօ..ⲟ pрρ...ⲣ qԛ.զ... sѕ..... u.υս... v.ν.... wԝ..... xхχ.... yу.....
"""
#: Further letters of the shape of a Latin one.
FURTHER = "ıi ɡg ɑa ҮY үy ӏl ӀI ϲc ϹC ϳj"
#: Letters of Russian that look like Latin ones.
RUSSIAN = frozenset("АВСЕНКМОРТХУасеорху")
def _classes() -> dict[str, dict[str, str]]:
    """For each letter that has look-alikes: script -> letter of that script."""
    found = {}
    for letters in SHAPES.split():
        spelled = {script: letter for script, letter in zip(SCRIPTS, letters) if letter != "."}
        found.update(dict.fromkeys(spelled.values(), spelled))
    for other, plain in FURTHER.split():
        found[other] = found.get(plain) or {"Latin": plain}
    return found


CLASSES = _classes()
#: Characters without a shape of their own; joiners and selectors inside emoji are kept.
INVISIBLE = regex.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0d\ufeff\uffa0\ufff0-\ufffb\U000e0000-\U000e0fff]"
    r"|(?<!\p{Extended_Pictographic}\ufe0f?[\U0001f3fb-\U0001f3ff]?)\u200d|\u200d(?!\p{Extended_Pictographic})"
    r"|(?<!\p{Emoji})[\ufe0e\ufe0f]"
)
SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
#: Whether a text can hold any of the two above.
ODD = re.compile("[\u00a0\u00ad\u034f\u061c\u115f\u1160\u1680\u17b4\u17b5\u180b-\u180f\u2000-\u200f\u202a-\u202f\u205f-\u206f\u3000\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U000e0000-\U000e0fff]")
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
OTHER_SCRIPT = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1c80-\u1c8f\u1f00-\u1fff\u2c80-\u2cff\u2de0-\u2dff\ua4d0-\ua4ff\ua640-\ua69f\uab70-\uabbf" + "".join(w[0] for w in FURTHER.split()) + "]")
SCRIPT = {name: regex.compile(rf"\p{{{name}}}") for name in (*SCRIPTS, "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew")}


@lru_cache(maxsize=50_000)
def scripts(letter: str) -> frozenset[str] | None:
    """Scripts a character could belong to; None where it fits all (digits, marks)."""
    if letter in CLASSES:
        return frozenset(CLASSES[letter])
    for name, pattern in SCRIPT.items():
        if pattern.match(letter):
            return frozenset((name,))
    return None


@lru_cache(maxsize=200_000)
def resolved(token: str) -> frozenset[str] | None:
    """The scripts that every character of a decomposed token fits; None if it fits all."""
    left: frozenset[str] | None = None
    for letter in set(token):
        own = scripts(letter)
        if own is not None:
            left = own if left is None else left & own
    if left and len(left) > 1:
        # codes with digits are Latin, and letters that Russian lacks do not make a Russian word
        rare = any(CLASSES[c].get("Cyrillic", "о") not in RUSSIAN for c in token if c in CLASSES)
        left = left & {"Latin"} or left if any(map(str.isdigit, token)) else left - {"Cyrillic"} if rare else left
    return left


@lru_cache(maxsize=200_000)
def _spell(token: str, script: str | None) -> str:
    """A token in one script; without one, each letter in the first script of its class."""
    out = []
    for letter in token:
        kinds = CLASSES.get(letter)
        out.append(letter if kinds is None else kinds[script] if script in kinds else next(iter(kinds.values())))
    return "".join(out)


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; null stays null and the empty text empty."""
    if not text or text.isascii():
        return text
    if ODD.search(text):
        text = SPACE.sub(" ", INVISIBLE.sub("", text))
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if not OTHER_SCRIPT.search(text):
        return text
    text = unicodedata.normalize("NFD", text)
    left = [resolved(token) for token in TOKEN.findall(text)]
    used = Counter(next(iter(scripts)) for scripts in left if scripts and len(scripts) == 1)

    def spelled(match: regex.Match) -> str:
        token = match.group()
        fits = resolved(token)
        if fits is None:
            return token
        return _spell(token, min(fits, key=lambda s: (-used[s], SCRIPTS.index(s) if s in SCRIPTS else 9)) if fits else None)

    return unicodedata.normalize("NFC", TOKEN.sub(spelled, text))


def consistent_column(text: Column) -> Column:
    """The consistent form as a column (Arrow batches)."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(consistent, na_action="ignore")

    return form(text)


def look_alikes(rows: DataFrame, key: str, text: str, expand: int | None = 1000) -> DataFrame:
    """Pairs ``a < b`` of keys whose texts differ but have one consistent form.

    Null texts take part in no pair; equal texts are no pair.  Rows are one per
    key.  Only fingerprints (128 bits of the text, 128 of its form) are shuffled,
    and only forms that hold two different texts, found by a map-side combined
    minimum and maximum, are joined; a form that a third of all rows share
    without a second spelling never reaches the join, and one with a second
    spelling is cut into blocks.  A text that more than ``expand`` keys share
    stands in pairs by its first key only (null: by all).
    """
    marked = kept(rows.select(F.col(key), *[c for c in rows.columns if c in ("t1", "t2", "f1", "f2")]), "forms")
    mixed = marked.groupBy("f1", "f2").agg(F.min(F.struct("t1", "t2")).alias("least"), F.max(F.struct("t1", "t2")).alias("most"))
    mixed = mixed.filter(F.col("least") != F.col("most")).select("f1", "f2")
    held = kept(marked.join(mixed, ["f1", "f2"], "left_semi"), "mixed")
    if expand is not None:
        large = held.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter(F.col("n") > expand).select("t1", "t2", "first")
        held = split_join(held, large, ["t1", "t2"], [key], "left").filter(F.col("first").isNull() | (F.col(key) == F.col("first"))).drop("first")
    met = split_pairs(held, ["f1", "f2"], key).filter((F.col("a.t1") != F.col("b.t1")) | (F.col("a.t2") != F.col("b.t2")))
    return met.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def with_forms(rows: DataFrame, text: str) -> DataFrame:
    """Adds the fingerprints of a text (t1, t2) and of its consistent form (f1, f2)."""
    formed = rows.withColumn("_form", consistent_column(F.col(text)))
    return formed.select("*", *fingerprint(F.col(text), "t"), *fingerprint(F.col("_form"), "f"))
