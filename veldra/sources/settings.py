"""Settings of a corpus: a small reader of EDN values, and directory settings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parent_directory
from ..operators.access import ancestors
from .corpus import files, root_of

LOOK_ALIKE = re.compile(r"(?i)^_?collections?\.edn$")
TOKEN = re.compile(r'[\s,]+|;[^\n]*|#_|#\{|[\[\](){}]|"(?:\\.|[^"\\])*"|[^\s,\[\](){}";]+')
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def read_values(text: str) -> list:
    """All EDN values of a text: maps, vectors, lists, sets (as lists), strings,
    numbers, booleans, nil; keywords keep their colon, symbols come as strings."""
    tokens, at = [], 0
    while at < len(text):
        match = TOKEN.match(text, at)
        if not match:
            raise ValueError(f"unreadable at {at}")
        if not re.match(r"[\s,;]", match[0]):
            tokens.append(match[0])
        at = match.end()

    def value(i: int):
        token = tokens[i]
        if token == "#_":
            return value(value(i + 1)[1])
        if token in ("[", "(", "{", "#{"):
            end = {"[": "]", "(": ")"}.get(token, "}")
            items, i = [], i + 1
            while tokens[i] != end:
                if tokens[i] == "#_":
                    i = value(i + 1)[1]
                    continue
                item, i = value(i)
                items.append(item)
            if token != "{":
                return items, i + 1
            if len(items) % 2:
                raise ValueError("a map with a key without value")
            keys = items[::2]
            if len({repr(k) for k in keys}) < len(keys):
                raise ValueError("a map with a key twice")
            return {str(k): v for k, v in zip(keys, items[1::2])}, i + 1
        if token in ("]", ")", "}"):
            raise ValueError("a closing bracket too many")
        if token[0] == '"':
            return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S), i + 1
        if token in ("true", "false", "nil"):
            return {"true": True, "false": False, "nil": None}[token], i + 1
        if re.fullmatch(r"[-+]?\d+", token):
            return int(token), i + 1
        if re.fullmatch(r"[-+]?\d+\.\d*(?:[eE][-+]?\d+)?", token):
            return float(token), i + 1
        return token, i + 1

    found, i = [], 0
    try:
        while i < len(tokens):
            if tokens[i] == "#_":
                i = value(i + 1)[1]
                continue
            item, i = value(i)
            found.append(item)
    except IndexError:
        raise ValueError("it ends within a value") from None
    return found


def problem(values: list) -> str | None:
    """Why values are no directory settings; null if they are."""
    if len(values) != 1 or not isinstance(values[0], dict):
        return "not one map"
    extra = set(values[0]) - {":name", ":read-groups"}
    if extra:
        return f"unknown keys: {', '.join(sorted(extra))}"
    groups = values[0].get(":read-groups", [])
    if not isinstance(groups, list) or not all(isinstance(g, str) for g in groups) or any(g.startswith(":") for g in groups):
        return "groups are not a list of strings"
    return None


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it, inside a task."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def settings_of(system: fs.FileSystem, base: str, directory: str) -> tuple[str, str | None, list[str] | None, bool] | None:
    """The settings of one directory; none where it has no such file.  A misnamed or
    malformed file breaks the directory, whatever else stands there."""
    listed = system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"), allow_not_found=True))
    found, broken = None, False
    for info in sorted((i for i in listed if i.is_file and LOOK_ALIKE.match(i.base_name)), key=lambda i: i.base_name):
        try:
            with system.open_input_stream(info.path) as read:
                values = read_values(read.read().decode("utf-8", "replace"))
            wrong = problem(values) if info.base_name == "_collection.edn" else "misnamed"
        except ValueError as error:
            wrong = str(error)
        broken = broken or bool(wrong)
        found = {} if wrong else values[0]
    if found is None:
        return None
    return (directory, None, None, True) if broken else (directory, found.get(":name"), found.get(":read-groups"), False)


def directory_settings(spark: SparkSession, folder: str, directories: DataFrame | None = None) -> DataFrame:
    """``path, name, declared_groups, broken`` of each directory with settings.

    Looked up in tasks, for the directories in use (``directory``; by default those of
    the document files) and all above them: others rule no document.  Until settings
    further down, nothing below a broken directory is readable.
    """
    root = root_of(spark, folder)
    if directories is None:
        directories = files(spark, folder).select(parent_directory(F.col("path")).alias("directory"))
    above = directories.select("directory").distinct().select(F.explode(ancestors(F.col("directory"))).alias("path")).distinct()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for batch in batches:
            rows = [row for row in (settings_of(system, base, path) for path in batch["path"]) if row]
            yield pd.DataFrame(rows, columns=["path", "name", "declared_groups", "broken"])

    return above.mapInPandas(look, "path string, name string, declared_groups array<string>, broken boolean")
