"""Parsing and chunking documents inside Spark tasks: one row in, its parts out.

A document is parsed where its row lies, without a shuffle.  A text that cannot be
parsed gives one row with the error and never fails the job.  Null and empty texts
have no sections and no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunker import ChunkOptions, chunk_section, index_text
from ..functions.markdown import Page, parse, parse_plain
from ..functions.tokens import estimate

SECTIONS = "path string, section_id string, parent_id string, heading string, level int, trail string, section_index int, char_start long, char_end long"
CHUNKS = "path string, chunk_id string, section_id string, ordinal int, text string, index_text string, tokens int, char_start long, char_end long, hard_cut boolean, error string"
LINKS = "path string, kind string, position int, destination string"


def page(path: str, text: str) -> Page:
    return parse_plain(text) if path.endswith(".txt") else parse(text)


def title(path: str, parsed: Page) -> str:
    """Front matter, else the first heading of level 1, else the base name."""
    heading = next((s.heading for s in parsed.sections if s.level == 1 and s.heading), None)
    stated = parsed.front.get("title")
    return (str(stated) if stated not in (None, "") and not isinstance(stated, list) else None) or heading or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _rows(documents: DataFrame, schema: str, make) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for path, text in zip(batch.path, batch.text) for row in make(path, text)], columns=columns)

    return documents.filter(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text").mapInPandas(run, schema)


def sections(documents: DataFrame) -> DataFrame:
    """Sections of ``path, text``, with ids ``<path>#<n>``."""

    def make(path: str, text: str):
        for n, s in enumerate(page(path, text).sections):
            yield path, f"{path}#{n}", None if s.parent is None else f"{path}#{s.parent}", s.heading, s.level, s.trail, n, s.start, s.end

    return _rows(documents, SECTIONS, make)


def chunks(documents: DataFrame, o: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of ``path, text``, with ids ``<path>::<ordinal>``; none crosses a section."""

    def make(path: str, text: str):
        try:
            parsed = page(path, text)
            name = title(path, parsed)
            ordinal = 0
            for n, s in enumerate(parsed.sections):
                for c in chunk_section(text, n, s, o):
                    part = text[c.start : c.end]
                    yield path, f"{path}::{ordinal}", f"{path}#{n}", ordinal, part, index_text(name, s.trail, part), estimate(part), c.start, c.end, c.hard or None, None
                    ordinal += 1
        except (ValueError, IndexError, RecursionError) as problem:
            yield path, None, None, None, None, None, None, None, None, None, repr(problem)

    return _rows(documents, CHUNKS, make)


def links(documents: DataFrame) -> DataFrame:
    """Link destinations and wiki names of ``path, text``, never from code."""

    def make(path: str, text: str):
        parsed = page(path, text)
        for kind, found in (("path", parsed.links), ("wiki", parsed.wikis)):
            for n, destination in enumerate(found):
                yield path, kind, n, destination

    return _rows(documents, LINKS, make)


def titles(documents: DataFrame) -> DataFrame:
    """``path, title, raw_links`` of ``path, text``; a column ``key`` comes along."""
    held = ["key", "path"] if "key" in documents.columns else ["path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [page(path, text) for path, text in zip(batch.path, batch.text)]
            found = {"title": [title(p, x) for p, x in zip(batch.path, pages)], "paths": [x.links for x in pages], "wiki": [x.wikis for x in pages]}
            yield pd.DataFrame({c: batch[c] for c in held} | found)

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in held) + ", title string, paths array<string>, wiki array<string>"
    parsed = documents.filter(F.col("path").isNotNull() & F.col("text").isNotNull()).select(*held, "text").mapInPandas(run, schema)
    return parsed.select(*held, "title", F.struct("paths", "wiki").alias("raw_links"))


#: Fixed value: the block of settings on the first line of a file.
FRONT = r"(?s)\A(---[ \t]*\r?\n.*?\r?\n---)"


def declared_groups(text):
    """``declared_groups, problem`` of a front matter.

    Fails closed: a ``read_groups`` that is repeated, indented, quoted, misspelt, without
    value, not a list of plain words, or outside the block is a problem.
    """
    block = F.regexp_extract(text, FRONT, 1)
    head = F.regexp_extract(text, r"(?s)\A((?:[^\n]*\n?){0,30})", 1)
    before = F.regexp_replace(head, r"(?sm)^#.*\z", "")
    anywhere = r"(?im)^[ \t]*[\"']?read[-_ ]?groups?[\"']?[ \t]*[:：]"
    exact = r"(?m)^read_groups:[ \t]+\[([^\]\r\n]*)\][ \t]*\r?$"
    loose = F.regexp_count(F.concat_ws("\n", block, F.replace(before, block, F.lit(""))), F.lit(anywhere))
    good = F.regexp_count(block, F.lit(exact))
    words = F.transform(F.split(F.regexp_extract(block, exact, 1), ","), lambda g: F.regexp_replace(F.trim(g), r'^"(.*)"$', "$1"))
    listed = F.filter(words, lambda g: g != "")
    odd = F.exists(listed, lambda g: g.rlike(r"['\"\[\]{}:]"))
    problem = F.when(loose == 0, None).when((loose != 1) | (good != 1) | odd, "read_groups is malformed")
    return F.when((good == 1) & problem.isNull(), listed).alias("declared_groups"), problem.alias("problem")
