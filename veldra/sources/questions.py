"""Question and user files of an evaluation, EDN or JSON, as frames.

A file is one value: a list of questions (``id, query, user, expected-docs,
expected-sections, must-not-docs``), or a map from user names to ``display-name, groups,
admin?``.  It is read and checked in a task; a file that is not of this form fails
the read, so that a misspelt key never makes an evaluation pass for nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .settings import read_values

QUESTIONS = "id string, query string, user string, expected_docs array<string>, expected_sections array<string>, must_not_docs array<string>"
USERS = "principal string, display_name string, groups array<string>, admin boolean"


def _value(path: str, text: str) -> object:
    values = [json.loads(text)] if path.endswith(".json") else read_values(text)
    if len(values) != 1:
        raise ValueError(f"{path}: not one value")
    return values[0]


def _plain(entry: object, known: set[str], path: str) -> dict:
    """An entry with keys without colons; unknown keys are an error."""
    if not isinstance(entry, dict):
        raise ValueError(f"{path}: an entry is no map")
    found = {key.lstrip(":"): value for key, value in entry.items()}
    if set(found) - known:
        raise ValueError(f"{path}: unknown keys {sorted(set(found) - known)}")
    return found


def _names(value: object, path: str) -> list[str] | None:
    if value is None:
        return None
    if not isinstance(value, list) or not all(isinstance(v, str) and v.strip() and not v.startswith(":") for v in value):
        raise ValueError(f"{path}: not a list of names: {value!r}")
    return value


def parsed_questions(path: str, text: str) -> list[tuple]:
    value, rows = _value(path, text), []
    if not isinstance(value, list):
        raise ValueError(f"{path}: not a list of questions")
    for n, entry in enumerate(value):
        q = _plain(entry, {"id", "query", "user", "expected-docs", "expected-sections", "must-not-docs"}, path)
        if not all(isinstance(q.get(key), str) and q[key].strip() for key in ("query", "user")):
            raise ValueError(f"{path}: question {n} lacks query or user")
        rows.append((str(q.get("id", n)).lstrip(":"), q["query"], q["user"], *(_names(q.get(key), path) for key in ("expected-docs", "expected-sections", "must-not-docs"))))
    return rows


def parsed_users(path: str, text: str) -> list[tuple]:
    value, rows = _value(path, text), []
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not a map of users")
    for name, entry in value.items():
        u = _plain(entry, {"display-name", "groups", "admin?"}, path)
        if not name.strip() or not isinstance(u.get("admin?", False), bool) or u.get("groups") is None:
            raise ValueError(f"{path}: user {name!r} lacks groups, or admin? is no boolean")
        rows.append((name, u.get("display-name"), sorted(set(_names(u["groups"], path))), u.get("admin?", False)))
    return rows


def _read(spark: SparkSession, path: str, schema: str, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(parse(path, text), columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QUESTIONS, parsed_questions)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, USERS, parsed_users)
