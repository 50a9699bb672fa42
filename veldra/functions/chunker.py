"""Cutting a section into chunks at natural boundaries, with overlap."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .markdown import Section
from .tokens import estimate, fit

SENTENCE = re.compile(r"[。！？；]\s*|[.!?](?=\s)\s*|\n\s*")
LINE = re.compile(r"\n\s*")


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in estimated tokens."""

    target: int = 350
    most: int = 500
    least: int = 60
    overlap: int = 60


@dataclass
class Chunk:
    section: int
    start: int
    fresh: int
    end: int
    hard: bool


def starts(text: str, block: tuple[str, int, int]) -> list[int]:
    """Where a chunk may start in a block: at it, after its sentences (or lines, in code and tables)."""
    kind, start, end = block
    pattern = LINE if kind in ("code", "table") else SENTENCE
    return [start, *(m.end() for m in pattern.finditer(text, start, end) if m.end() < end)]


def units(text: str, block: tuple[str, int, int], o: ChunkOptions) -> list[tuple[int, int, bool]]:
    """A block whole, or its segments, or pieces of a segment that is too long even alone."""
    _, start, end = block
    if estimate(text[start:end]) <= o.most:
        return [(start, end, False)]
    edges = [*starts(text, block), end]
    out = []
    for a, b in zip(edges, edges[1:]):
        b = a + len(text[a:b].rstrip())
        while b > a and estimate(text[a:b]) > o.most:
            stop = max(fit(text, a, b, o.most), a + 1)
            out.append((a, stop, True))
            a = stop
        if b > a:
            out.append((a, b, False))
    return out


def chunk_section(text: str, number: int, section: Section, o: ChunkOptions) -> list[Chunk]:
    """Chunks of one section: closed at the target, never above the most, each starting
    with as much of the one before as the overlap and the most allow.  A section without
    blocks (a heading alone) has none."""
    blocks = section.blocks
    cuts = [c for block in blocks for c in starts(text, block)]
    chunks: list[Chunk] = []
    now: Chunk | None = None
    for a, b, hard in (u for block in blocks for u in units(text, block, o)):
        if now and (estimate(text[now.start : now.end]) >= o.target or estimate(text[now.start : b]) > o.most):
            chunks.append(now)
            room = min(o.overlap, o.most - estimate(text[a:b]))
            before = [c for c in cuts if now.start < c < now.end and estimate(text[c : now.end]) <= room and estimate(text[c:b]) <= o.most]
            now = Chunk(number, before[0] if before and not hard else a, a, b, hard)
        elif now:
            now.end, now.hard = b, now.hard or hard
        else:
            now = Chunk(number, a, a, b, hard)
    if now:
        chunks.append(now)
    if len(chunks) > 1:
        tail, before = chunks[-1], chunks[-2]
        if estimate(text[tail.fresh : tail.end]) < o.least and estimate(text[before.start : tail.end]) <= o.most:
            before.end, before.hard = tail.end, before.hard or tail.hard
            chunks.pop()
    return chunks


def index_text(title: str | None, trail: str | None, text: str, file_label: str = "文件：", section_label: str = "章節：") -> str:
    """What is indexed of a chunk: title, trail where there is one, a blank line, the text."""
    lines = [f"{file_label}{title or ''}"] + ([f"{section_label}{trail}"] if trail else [])
    return "\n".join(lines) + "\n\n" + text
