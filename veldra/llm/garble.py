"""Text decoded with the wrong character encoding: finding and restoring it.

A best-first search over encode, decode and unescape steps starts at a damaged
piece of text and looks for the cheapest text within reach, where the cost tells
how implausible the characters are in their places (controls and symbols inside
words, capitals after small letters, scripts mixed within a word, letters that
are rare in their language, substitution marks).  States seen before are not
visited again, and a state is only followed while its cost can still lead to the
best.  A document is a case if the search makes some piece of it clearly cheaper
than it stands, or if it holds marks of characters that a decoder gave up.

Pieces are runs without ASCII white space, parted into CJK and other characters,
so that damage in part of a text does not depend on the rest.  An escape (character
reference, ``\\u`` escape, quoted bytes) of a letter beyond ASCII is a damaged piece
too; references to signs (``&amp;``, ``&lt;``, ``&nbsp;``) are sound.  What stands
between backquotes is only quoted and is left alone.

The search has no cap: a step is only followed if it read UTF-8 or an escape, which
shortens the text, so that there are few states and every one of them is visited
that costs less than ``AHEAD`` more than the state it came from (what an escape
stands for, always).
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from codecs import getincrementaldecoder
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that text was read with by mistake, and that it was really in.
READ_AS = ("sloppy-1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "sloppy-gbk", "gb18030", "big5")
WRITTEN_IN = ("utf-8", "sloppy-1252", "cp1251", "koi8_r", "cp866", "big5", "gb18030")
HAN = ("big5", "gb18030")
#: Encodings of READ_AS that make Han characters, with those that such a text was really in.
READ_AS_HAN = {"sloppy-gbk": ("utf-8", "big5"), "gb18030": ("utf-8", "big5"), "big5": ("utf-8", "gb18030")}
#: Russian letters with their share in running text, per mille.
RUSSIAN = {
    "о": 109, "е": 84, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 43, "к": 35,
    "м": 32, "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19, "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 15,
    "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 0.4, "ё": 20,
}
#: Accented letters that are common in some Western language.
COMMON = "àáâãäçèéêëíîïñóôõöùúûüßœåøæ"
#: Letters that pass for those of another script.
ALIKE = frozenset("aeopcyxijsABEKMHOPCTXYIаеорсухіјѕһӏԁԛԝАВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι")
#: Marks that are combined with Western letters or emoji, here and there.
MARKS = frozenset((*range(0x300, 0x305), 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328, 0x20E3, 0xFE0E, 0xFE0F))
MARGIN = 2.5
AHEAD = 4.0

CJK = "ᄀ-ᇿ⺀-〿぀-鿿ꥠ-꥿가-퟿豈-﫿︰-﹏＀-￯\U00020000-\U0003ffff"
WORD = re.compile("[^ \t\n\r\f\v]+")
#: Characters that continue a UTF-8 sequence read as Latin-1 or Windows-1252.
CONTINUED = "\x80-\xbf" + bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
#: Parts of a word; a very long one is cut in front of an ASCII character, else of one that starts a sequence.
PART = re.compile(f"[{CJK}]+|[^{CJK}]{{1,4000}}(?![^\x00-\x7f{CJK}])|[^{CJK}]{{1,4000}}(?![{CONTINUED}])|[^{CJK}]{{1,4000}}")
HAN_LETTER = re.compile("[㐀-鿿]")
CJK_LETTER = re.compile(f"[{CJK}]")
OTHER = re.compile(f"[^\x00-\x7f{CJK}]")
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of one letter beyond ASCII (Romance, Russian).
ONE_LETTER = frozenset("àáéèавикосуяэ")
#: Marks that stand alone between words, and those that East Asian encodings write as two bytes.
ALONE, WIDE_MARKS = "–—€•", "–—―‐‥…‘’“”•€"
DEGREE = re.compile(r"°[CF]\b")
BOX = re.compile("[\u2500-\u259f]")
QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
ESCAPE = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[a-zA-Z]{2,8});|\\u[0-9a-fA-F]{4}|(?:=[89A-F][0-9A-F]){2,}")


def _misread_han() -> re.Pattern:
    """Runs of the Han characters that bytes of UTF-8 make when read as GBK."""
    found = []
    for lead in range(0x81, 0xFF):
        for trail in range(0x40, 0xFF):
            if (0x80 <= lead <= 0xBF and (0x80 <= trail <= 0xBF or 0xE2 <= trail <= 0xF0)) or (0xE2 <= lead <= 0xF0 and 0x80 <= trail <= 0xBF):
                for codec in ("gbk", "gb18030"):  # the latter has private characters where the former has none
                    try:
                        found.append(bytes((lead, trail)).decode(codec))
                    except UnicodeDecodeError:
                        pass
    return re.compile("[" + "".join(sorted(set(found))) + "�€]{3,}|馃[㐀-鿿]+")


MISREAD_HAN = _misread_han()
#: The same for Russian letters, and Western letters within a word of ASCII ones.
MISREAD_RUSSIAN = re.compile("[" + "".join(bytes((a, b)).decode("gbk") for a in (0xD0, 0xD1) for b in range(0x80, 0xC0)) + "]{3,}")
MISREAD_EMOJI = re.compile("馃[㐀-鿿]")
MISREAD_LETTERS = frozenset(bytes((a, b)).decode("gbk") for a in (0xC3, 0xC4, 0xC5) for b in range(0x80, 0xC0))
#: Runs that may be the bytes of another East Asian encoding, with the ASCII ones and marks that those make.
RARE_HAN = re.compile(f"[{CJK}-][{CJK}-\x21-\x7e€°±·×÷§¨Ͱ-ӿ‐-♯]{{3,4000}}")
WITHIN = re.compile("[a-zA-Z][一-龥]|[一-龥][a-z]")
LETTER_COST = {form: max(0.4, (8 - math.log2(share)) / 2) for letter, share in RUSSIAN.items() for form in (letter, letter.upper())}


def _east_asian_cost(char: str) -> float:
    """Cost by the rank of a character in the national sets, whose first levels hold the frequent ones."""
    code = ord(char)
    lead = {}
    for codec in ("big5", "gb2312", "euc_kr", "euc_jp"):
        try:
            lead[codec] = char.encode(codec)[0]
        except UnicodeEncodeError:
            pass
    if 0xAC00 <= code < 0xD800 or 0x1100 <= code < 0x1200:
        return 0.9 if "euc_kr" in lead else 3.0
    if 0xA4 <= lead.get("big5", 0) <= 0xC6 or 0xB0 <= lead.get("gb2312", 0) <= 0xD7:
        return 0.7
    if "big5" in lead:
        return 0.7 if code < 0x3040 or code > 0xFF00 else 1.1
    return 1.1 if 0xB0 <= lead.get("euc_jp", 0) <= 0xCF else 1.6


@lru_cache(maxsize=100_000)
def kind(char: str) -> tuple[str, float]:
    """Class of a character and what it costs on its own.

    Classes: a ASCII letter, d digit, p plain ASCII, l other Latin letter, c
    Cyrillic, g Greek, h CJK, s symbol that is odd inside words, n neutral, x bad.
    """
    code = ord(char)
    if code < 128:
        if char.isalpha():
            return "a", 0.0
        return ("d", 0.0) if char.isdigit() else ("p", 0.0) if code >= 32 or char in "\t\n\r\f" else ("n", 0.5)
    if code < 0xA0 or code == 0xFFFD or 0xE000 <= code < 0xF900:
        return "x", 6.0
    if char in "ªº":
        return "s", 0.8
    category = unicodedata.category(char)
    if category == "Cn":
        return "x", 8.0
    if re.match(f"[{CJK}]", char):
        if 0xFF61 <= code <= 0xFF9F or 0x3100 <= code <= 0x312F:
            return "h", 3.0
        if 0x3041 <= code <= 0x30FE:
            return "h", 0.7
        return "h", _east_asian_cost(char)
    if 0x2B0 <= code < 0x300:
        return "n", 5.0  # an accent that stands by itself
    if category[0] == "L":
        name = unicodedata.name(char, "")
        if name.startswith("LATIN"):
            plain = char.lower()
            return "l", 1.0 if plain in COMMON else 1.2 if 0xFB00 <= code <= 0xFB06 else 2.0
        if name.startswith("CYRILLIC"):
            return "c", LETTER_COST.get(char, 1.5 if char in ALIKE else 4.0)
        if name.startswith("GREEK"):
            return "g", 1.0
        return "n", 0.5 if code > 0x1D000 else 3.0
    if category[0] == "M":
        return "n", 0.4 if code in MARKS else 4.0
    if code in (0x200B, 0x200C, 0x200D, 0x200E, 0x2060, 0xFEFF, 0x2007, 0x202F) or code > 0x1F000 or 0x2600 <= code < 0x27C0:
        return "n", 0.3
    if char in "–—’‘“”€…•№℃":
        return "q", 0.4
    if char == "\xa0" or char == "\xad":
        return "b", 0.4
    if char in "°²³¹½¼¾§¿¡":
        return "s", 0.8
    return "s", 1.2


def cost(text: str) -> float:
    """How implausible a text is: 0 for ASCII, more for every odd character in its place."""
    total, before, last = 0.0, "p", ""
    lower, inner = False, ""
    for run in LETTERS.findall(text):
        kinds = [kind(c)[0] for c in run]
        if "c" in kinds or "g" in kinds:  # two scripts in a word, but for letters that pass for the other's
            strange = [c not in ALIKE for c, k in zip(run, kinds) if k in "cg"], [c not in ALIKE for c, k in zip(run, kinds) if k in "al"]
            total += 4.0 * min(map(sum, strange))
        if len(run) == 1 and run in images()[0]:
            total += 3.5
    for run in MISREAD_RUSSIAN.findall(text):  # what Russian letters and emoji become
        total += 1.0 * len(run)
    total += 2.0 * len(MISREAD_EMOJI.findall(text))
    if not text.isascii() and (images()[2].search(text) or text in images()[1]):
        total += 4.0
    if "°" in text:
        total -= 1.0 * len(DEGREE.findall(text))
    if "&" in text or "\\u" in text or "=" in text:
        total += 3.0 * sum(map(_meant, ESCAPE.findall(text)))
    for char in text:
        now, own = kind(char)
        total += own if now not in "cg" or before not in "al" or own > 1.5 else 1.5
        if now in "alcg":
            total += 2.5 if inner else 0.8 if last == "’" else 0.0  # a mark that only stands between words
            small = char.islower()
            if before in "alcg":
                if lower and not small and char.isupper() and (now in "lc" or before in "lc"):
                    total += 3.5  # a capital after a small letter
                if now == "l" and before == "l":
                    total += 0.6 if not small and last.isupper() or last.lower() in "çõ" or char.lower() in "çß" else 2.0
            elif before == "s":
                total += 0.5 if last in "°²³¹½¼¾§¿¡«»" and last != "¼" else 1.5
            elif before == "x":
                total += 0.5
            elif before == "h" and now in "lcg":
                total += 2.0
            lower = small
        elif now == "s":
            if before in "alcg":
                total += 1.5 if char in "°²³»ªº´" else 2.5
            elif before in "sxh":
                total += -1.0 if 0x2500 <= ord(char) < 0x25A0 and 0x2500 <= ord(last) < 0x25A0 else 0.0 if char in "¿¡" else 1.5
            if char not in "°²³¹§¿¡«»·±÷×©®™£¥¢ªº´" and not 0x2500 <= ord(char) < 0x25A0:
                total += 0.5
        elif now == "q":
            if before == "q" and char != last:
                total += 1.5
            if before in "alcg" and char != "’":
                inner = char
            if before in "lcgsx" and char in "€“”…•‘":
                total += 2.5
            elif before in "acl" and char in "€“•":
                total += 2.0
        elif now == "b":
            total += 2.0 if before in "ls" or char == "\xad" and before != "a" else 0.6
        elif now == "h" and before in "lcgsx":
            total += 1.0
        if now == "h" and before == "a" and last.islower() and char in MISREAD_LETTERS or before == "h" and now == "a" and char.islower() and last in MISREAD_LETTERS:
            total += 2.5  # a small Latin letter beside what an accented one becomes
        if now != "q":
            inner = ""
        before, last = now, char
    return total


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of a text; Windows-1252 lets the controls that it does not define pass,
    GBK has the euro sign as one byte and leaves out the marks of lost ones."""
    if codec == "sloppy-gbk":
        try:
            return b"\x80".join(part.encode("gb18030") for part in text.replace("�", "").split("€"))
        except UnicodeEncodeError:
            return None
    if codec != "sloppy-1252":
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError:
        out = bytearray()
        for char in text:
            try:
                out += char.encode("cp1252")
            except UnicodeEncodeError:
                if ord(char) > 255:
                    return None
                out.append(ord(char))
        return bytes(out)


def _decode(data: bytes, codec: str, least: int = 7, share: int = 8) -> str | None:
    try:
        return data.decode("cp1252" if codec == "sloppy-1252" else codec)
    except UnicodeDecodeError:
        if codec == "sloppy-1252":
            return "".join(_decode_one(b) for b in data)
        if codec == "utf-8":  # a character that was cut at the end of the damage
            text = data.decode("utf-8", "replace")
            return text if len(text) >= least and text.count("�") * share <= len(text) else None
        return None


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=256)
def _decode_one(byte: int) -> str:
    try:
        return bytes((byte,)).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


@lru_cache(maxsize=1)
def images() -> tuple[frozenset[str], frozenset[str], re.Pattern]:
    """What a mark becomes that was written in one encoding and read, byte by byte, in
    another: letters of marks that stand alone; two characters of those that East
    Asian encodings write as two bytes; and, as a pattern, n’t with a letter as its
    apostrophe, a word between letters that are its quotation marks, and a sign before
    C or F that is the degree sign."""

    def read(marks: str, written: tuple[str, ...]) -> set[str]:
        found = set()
        for mark in marks:
            for codec in written:
                data = _encode(mark, codec)
                for other in READ_AS if data else ():
                    if other not in READ_AS_HAN and (there := _decode(data, other)) is not None and there != mark:
                        found.add(there)
        return found

    single = tuple(c for c in WRITTEN_IN if c not in HAN and c != "utf-8")
    alone = {c for c in read(ALONE, single) if len(c) == 1 and c.isalpha() and c not in ALIKE and c.lower() not in ONE_LETTER}
    within = "".join(sorted(c for c in read("’", single) if len(c) == 1 and c.isalpha()))
    degrees = "".join(sorted(c for c in read("°", single) if len(c) == 1 and not c.isalpha()))
    quoted = set()
    for marks in ("“”", "‘’"):
        for codec in single:
            for other in READ_AS if (data := _encode(marks, codec)) else ():
                pair = None if other in READ_AS_HAN else _decode(data, other)
                if pair and len(pair) == 2 and pair != marks and pair.isalpha():
                    quoted.add(f"^{pair[0]}[A-Za-z][ -~]*{pair[1]}(?=\\W*$)")
    return frozenset(alone), frozenset(w for w in read(WIDE_MARKS, HAN) if len(w) == 2 and not w.isalpha()), re.compile("|".join([rf"n[{within}]t\b", rf"(?<![^\W_])[{re.escape(degrees)}][CF]\b", *sorted(quoted)]))


@lru_cache(maxsize=10_000)
def _meant(escape: str) -> bool:
    """Whether an escape stands for a letter beyond ASCII, or for bytes."""
    return escape.startswith("=") or any(c > "\x7f" and c.isalpha() for c in unescaped(escape))


def unescaped(text: str) -> str:
    """A text with its character references, escapes and quoted bytes read."""
    text = html.unescape(text)
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"(?:=[89A-F][0-9A-F])+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), text)


def _price(text: str, han: bool) -> float:
    """Cost of a state; among Han characters a lost one is no news, it only is not had again."""
    return cost(text.replace("�", "")) + 1.5 * text.count("�") if han else cost(text)


def search(text: str, codecs: tuple[str, ...] = READ_AS, cross: bool = True) -> tuple[str, float]:
    """The cheapest text within reach, and its cost; ``cross``: also by the other Han encoding."""
    only_han = codecs == tuple(READ_AS_HAN)
    start = _price(text, only_han)
    best, best_cost = text, start
    drawn = len(BOX.findall(text))
    seen: set[str] = {text}
    queue: list[tuple[float, int, str]] = [(start, 0, text)]
    while queue:
        here_cost, depth, here = heappop(queue)
        steps = [(unescaped(here), 0.0, None)] if "&" in here or "\\u" in here or "=" in here else []
        # bytes of Han characters read one by one show symbols among the letters
        kinds = [kind(c)[0] for c in here]
        han = "c" not in kinds and (sum(k in "sbx" for k in kinds) >= 2 or len(here) >= 16 or here in images()[1])
        # whatever is encoded as GBK can be, so only what holds Han characters may come from there
        if "h" in kinds:
            for codec, trues in READ_AS_HAN.items():
                if codec not in codecs or "�" in here and not (only_han and codec == "sloppy-gbk") or (data := _encode(here, codec)) is None:
                    continue
                for true in trues:
                    there = _decode(data, true, 2, 4) if true == "utf-8" or cross and not _is_utf8(data) else None
                    if there:
                        steps.append((there, 0.0 if true == "utf-8" else 3.0 * (depth > 0) + 1.5, true == "utf-8"))
        read = [data for codec in codecs if codec not in READ_AS_HAN and (data := _encode(here, codec)) is not None]
        sure = any(map(_is_utf8, read))
        for data in dict.fromkeys(read):
            for true in WRITTEN_IN:
                if true in HAN and (sure or not han):
                    continue
                there = _decode(data, true)
                if there is not None:
                    steps.append((there, 0.0 if true == "utf-8" else 3.0 * (depth > 0) + (1.5 if true in HAN else 0.6), true == "utf-8"))
        for there, extra, follow in steps:
            if there in seen:
                continue
            seen.add(there)
            there_cost = _price(there, only_han) + extra + (20.0 if len(BOX.findall(there)) > drawn else 0.0)
            if there_cost < best_cost:
                best, best_cost = there, there_cost
            # damage upon damage is always a misreading of UTF-8, so only what such a step gave is followed
            if follow is None or follow and there_cost < here_cost + AHEAD:
                heappush(queue, (there_cost, depth + 1, there))
    return best, best_cost


@lru_cache(maxsize=200_000)
def restored_part(part: str) -> str:
    """A part as it was meant; the part itself where nothing clearly cheaper is within reach."""
    start = cost(part)
    if start < MARGIN:
        return part
    best, best_cost = search(part)
    if best_cost > 0.8 * start:
        return part
    letters = "".join(LETTERS.findall(part))
    if (letters.istitle() or letters.islower()) and all(kind(c)[0] == "c" for c in letters) and best_cost > 0.6 * start:
        return part  # a Russian word with its capitals in their place
    # bytes that happen to be UTF-8 are strong evidence by themselves
    utf8 = any((data := _encode(part, codec)) is not None and _is_utf8(data) for codec in READ_AS if codec not in READ_AS_HAN)
    return best if start - best_cost >= (MARGIN / 2 if utf8 else MARGIN) else part


@lru_cache(maxsize=200_000)
def restored_han(run: str, cross: bool = False) -> str:
    """A run with Han characters as it was meant, by a search that starts from the Han encodings."""
    if not CJK_LETTER.search(run):
        return run
    start = _price(run, True)
    if start < MARGIN:
        return run
    best, best_cost = search(run, tuple(READ_AS_HAN), cross)
    if best == run or best_cost > 0.8 * start:
        return run
    data = [d for codec in READ_AS_HAN if (d := _encode(run, codec)) is not None]
    utf8 = any(_starts_utf8(d) for d in data)
    return best if start - best_cost >= (MARGIN / 2 if utf8 else MARGIN) else run


def _starts_utf8(data: bytes) -> bool:
    """Whether bytes are UTF-8 but for a character that was cut at their end."""
    try:
        getincrementaldecoder("utf-8")().decode(data)
        return True
    except UnicodeDecodeError:
        return False


def _rare(run: str) -> bool:
    """Whether a run holds clearly more rare characters than a sound text does."""
    han = [kind(c)[1] for c in run if c > "\x7f"]
    return len(han) >= 4 and sum(c > 0.7 for c in han) * 4 >= len(han)


def restored_word(word: str) -> str:
    """A word (no ASCII white space) with every damaged part restored."""
    # the patterns only tell which runs are worth a search of their own
    if WITHIN.search(word) and len(word) <= 4000 and not HAN_LETTER.search(other := restored_han(word)) and "�" not in other:
        return other
    word = MISREAD_RUSSIAN.sub(lambda m: restored_han(m.group()), word)
    word = MISREAD_HAN.sub(lambda m: restored_han(m.group()), word)
    word = RARE_HAN.sub(lambda m: restored_han(m.group(), True) if _rare(m.group()) else m.group(), word)
    escaped = ESCAPE.search(word) is not None
    if not escaped and not OTHER.search(word):
        return word
    out = []
    for match in PART.finditer(word):
        part = match.group()
        if part.isascii() and not (escaped and ESCAPE.search(part)):
            out.append(part)
        elif re.match(f"[{CJK}]", part):
            out.append(part)
        else:
            out.append(restored_part(part))
    return "".join(out)


@lru_cache(maxsize=100_000)
def _damaged(word: str) -> bool:
    """Whether the search leads from a word to another, or ends at lost characters."""
    return restored_word(word) != word or "\ufffd" in word


def _odd(word: str) -> bool:
    return not word.isascii() or ESCAPE.search(word) is not None


def damaged(text: str | None) -> bool:
    """Whether a text was, in whole or in part, decoded with a wrong encoding."""
    if not text:
        return False
    if "`" in text:
        text = QUOTED.sub("``", text)
    return _odd(text) and any(_odd(word) and _damaged(word) for word in WORD.findall(text))


def restored(text: str | None) -> str | None:
    """A text with its damaged parts restored; quoted parts stay."""
    if not text or not _odd(text):
        return text
    quotes = [m.span() for m in QUOTED.finditer(text)]
    out, at = [], 0
    for start, end in [*quotes, (len(text), len(text))]:
        out.append(WORD.sub(lambda m: restored_word(m.group()), text[at:start]))
        out.append(text[start:end])
        at = end
    return "".join(out)


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, restored_text`` of every garbled document.

    Whole texts are searched.  Null and empty texts are no cases; a text whose
    lost characters cannot be had again comes out with its marks.  Repeated rows
    come out as often as they stand; other columns are ignored.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cases = batch[[damaged(t) for t in batch["text"]]]
            yield pd.DataFrame({"key": cases["key"], "restored_text": cases["text"].map(restored)})

    kind_of_key = dict(documents.dtypes)[key]
    # only texts that hold something beyond ASCII or an escape can be cases
    odd = F.col(text).rlike(r"[^\x00-\x7f]|&[#a-zA-Z0-9]+;|\\u[0-9a-fA-F]{4}|=[89A-F][0-9A-F]=[89A-F]")
    rows = documents.filter(odd).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(find, f"key {kind_of_key}, restored_text string").withColumnRenamed("key", key)
