"""Columns for corpus paths and links, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_directory(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def base_name(path: Column) -> Column:
    """Last segment of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"\.[^.]+$", "")


def resolved(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments; null where it leaves the root."""
    step = lambda done, part: (
        F.when(done.isNull() | part.isin("", "."), done)
        .when(part != "..", F.concat(done, F.array(part)))
        .when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
    )
    segments = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.array_join(segments, "/")


def plain_link(link: Column) -> Column:
    """A link without anchor and query, percent-decoded, ``+`` kept.

    Null where the percent code is malformed: such a text names no file.
    """
    bare = F.regexp_replace(link, r"(?s)[#?].*$", "")
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.when(bare.contains("%") | bare.contains("+"), decoded).otherwise(bare)


def is_document_link(link: Column) -> Column:
    """Whether a plain link is relative and names a Markdown file."""
    return link.rlike(r"(?i)\.(md|markdown)$") & ~link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") & ~link.startswith("/")


def link_target(directory: Column, link: Column) -> Column:
    """Path meant by a link written in a file of a directory; null if it is no document link."""
    plain = plain_link(link)
    full = F.when(directory == "", plain).otherwise(F.concat_ws("/", directory, plain))
    return F.when(is_document_link(plain), resolved(full))
