"""A Markdown file as sections, blocks and links: a scanner over lines.

Covers ATX and Setext headings, fenced and indented code, tables, lists, quotes,
HTML blocks, thematic breaks and front matter.  Inline markup is only read as far
as headings and links need it, links by reference included.  Offsets are code
points; every block is a span of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\r?\Z")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*\r?\Z")
BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*\r?\Z")
ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|\r?\Z)")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?\Z")
HTML = re.compile(r" {0,3}<(?:[a-zA-Z][^ <>]*[ >]|/|!--)")
CODE_SPAN = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
INLINE_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s<>]*)*)>?(?:\s+[\"'(][^)]*)?\s*\)")
#: A definition of a link by reference, on a line of its own.
DEFINITION = re.compile(r"^ {0,3}\[([^\[\]]+)\]:[ \t]*<?([^\s<>]+)>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*\r?$", re.M)
#: A link by reference: text and label, or the label alone; not part of a wiki link.
REFERENCE = re.compile(r"(?<!\[)!?\[((?:[^\[\]]|\[[^\[\]]*\])+)\](?:\[([^\[\]]*)\])?(?![\[(:\]])")
WIKI = re.compile(r"\[\[([^\[\]|#\n]+)(?:[|#][^\[\]\n]*)?\]\]")


@dataclass
class Section:
    level: int
    heading: str | None
    trail: str
    start: int
    end: int
    parent: int | None
    blocks: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Page:
    front: dict[str, object]
    sections: list[Section]
    links: list[str]
    wikis: list[str]


def _value(text: str) -> object:
    """A value of the front matter: a quoted string, a list, a number, true or false, else the words."""
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if len(text) > 1 and text[0] == "[" and text[-1] == "]":
        return [_value(part.strip()) for part in re.findall(r'(?:"(?:\\.|[^"\\])*"|[^,"])+', text[1:-1]) if part.strip()]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[-+]?\d+\.\d+(?:[eE][-+]?\d+)?", text) else text


def front_matter(text: str) -> tuple[dict[str, object], int]:
    """``key: value`` lines of the block on the first line, and where the body starts."""
    match = FRONT.match(text)
    if not match:
        return {}, 0
    pairs = (re.match(r"([A-Za-z_][\w-]*):[ \t]+(.*?)[ \t\r]*$", line) for line in match[1].split("\n"))
    return {m[1]: _value(m[2]) for m in pairs if m}, match.end()


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


def destinations(shown: list[str]) -> list[str]:
    """Destinations of the links of texts without code, in their order."""
    defined: dict[str, str] = {}
    for text in shown:
        for match in DEFINITION.finditer(text):
            defined.setdefault(_label(match[1]), match[2])
    found = []
    for text in shown:
        text = DEFINITION.sub("", text)
        here = [(m.start(), m[2]) for m in INLINE_LINK.finditer(text) if m[2]]
        if defined:
            named = ((m.start(), defined.get(_label(m[2] or m[1]))) for m in REFERENCE.finditer(text))
            here += [(at, destination) for at, destination in named if destination]
        found += [destination for _, destination in sorted(here)]
    return found


def plain(text: str) -> str:
    """Heading text without markup; what stands in code spans is kept."""
    text = INLINE_LINK.sub(r"\1", text)
    text = WIKI.sub(r"\1", text)
    text = re.sub(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", text, flags=re.S)
    text = re.sub(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text, flags=re.S)
    return re.sub(r"`+", "", text).strip()


def scan_blocks(text: str, at: int) -> list[tuple[str, int, int, int, str]]:
    """Blocks as ``kind, start, end, level, heading``; blank lines end most of them."""
    found: list[list] = []
    fence = ""
    open_kind = ""  # of the block that the next line may continue
    lines = re.findall(r"[^\n]*\n|[^\n]+", text[at:])
    starts = [at]
    for line in lines:
        starts.append(starts[-1] + len(line))
    for n, line in enumerate(lines):
        start, bare = starts[n], line.rstrip("\r\n")
        end = start + len(bare)
        add = lambda kind, level=0, heading="": found.append([kind, start, end, level, heading])  # noqa: E731, B023
        if fence:
            found[-1][2] = end
            close = FENCE.match(bare)
            if close and close[1][0] == fence[0] and len(close[1]) >= len(fence) and not bare.strip().strip(fence[0]):
                fence, open_kind = "", ""
            continue
        if not bare.strip():
            open_kind = open_kind + " gap" if open_kind in ("list", "code") else ""
            continue
        opening = FENCE.match(bare)
        if opening:
            add("code")
            fence, open_kind = opening[1], ""
            continue
        if open_kind == "paragraph" and UNDERLINE.match(bare):
            first = found.pop()
            level = 1 if bare.strip()[0] == "=" else 2
            found.append(["heading", first[1], end, level, plain(text[first[1] : first[2]])])
            open_kind = ""
            continue
        heading = ATX.match(bare)
        if heading:
            add("heading", len(heading[1]), plain(heading[2] or ""))
            open_kind = ""
            continue
        if BREAK.match(bare):
            open_kind = ""
            continue
        indented = bare.startswith(("    ", "\t"))
        if open_kind.startswith("list") and (ITEM.match(bare) or indented or open_kind == "list"):
            found[-1][2] = end
            open_kind = "list"
        elif indented and (open_kind.startswith("code") or open_kind != "paragraph"):
            if open_kind.startswith("code"):
                found[-1][2] = end
            else:
                add("code")
            open_kind = "code"
        elif ITEM.match(bare):
            add("list")
            open_kind = "list"
        elif bare.lstrip().startswith(">"):
            if open_kind == "blockquote":
                found[-1][2] = end
            else:
                add("blockquote")
            open_kind = "blockquote"
        elif open_kind in ("table", "html", "blockquote") or open_kind == "paragraph" and not HTML.match(bare):
            found[-1][2] = end
        elif HTML.match(bare):
            add("html")
            open_kind = "html"
        elif "|" in bare and n + 1 < len(lines) and "|" in lines[n + 1] and DELIMITER.match(lines[n + 1].rstrip("\n")):
            add("table")
            open_kind = "table"
        else:
            add("paragraph")
            open_kind = "paragraph"
    return [tuple(b) for b in found]


def parse(text: str) -> Page:
    """The page of a Markdown text; an empty text has no sections."""
    front, body = front_matter(text)
    sections: list[Section] = []
    stack: list[int] = []
    bare: list[str] = []
    wikis: list[str] = []
    for kind, start, end, level, heading in scan_blocks(text, body):
        if kind == "heading":
            while stack and sections[stack[-1]].level >= level:
                stack.pop()
            names = [sections[i].heading for i in stack] + [heading]
            sections.append(Section(level, heading, " > ".join(n for n in names if n), start, end, stack[-1] if stack else None))
            stack.append(len(sections) - 1)
        else:
            if not sections:
                sections.append(Section(0, None, "", start, end, None))
            sections[-1].end = end
            sections[-1].blocks.append((kind, start, end))
        if kind not in ("code", "html"):
            shown = CODE_SPAN.sub(lambda m: " " * len(m[0]), text[start:end])
            bare.append(shown)
            wikis += [m[1].strip() for m in WIKI.finditer(shown)]
    return Page(front, sections, destinations(bare), wikis)


def parse_plain(text: str) -> Page:
    """A plain text: one section of paragraphs between blank lines."""
    blocks = [("paragraph", m.start(), m.end()) for m in re.finditer(r"\S(?:.*\S)?(?:\r?\n[^\S\n]*\S.*)*", text)]
    spans = [(k, s, s + len(text[s:e].rstrip())) for k, s, e in blocks]
    return Page({}, [Section(0, None, "", spans[0][1], spans[-1][2], None, spans)] if spans else [], [], [])
