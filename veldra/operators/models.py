"""Models as callables that run in Spark tasks: embedding, reranking, chat.

A callable is passed in and must be picklable; clients of HTTP endpoints are at the
end.  One failing call never fails a stage: it gives an error column, or leaves
its query in its order.
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded(texts: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 32) -> DataFrame:
    """``key, vec, error``: each text's vector, or what went wrong with its batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors = embed(part["text"].tolist())
                    if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                        raise ValueError("another number of vectors or dimensions than asked for")
                    yield pd.DataFrame({"key": part["key"], "vec": [list(map(float, v)) for v in vectors], "error": None})
                except Exception as problem:  # noqa: BLE001  a model may fail in any way
                    yield pd.DataFrame({"key": part["key"], "vec": None, "error": str(problem)[:500]})

    asked = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return asked.mapInPandas(run, "key string, vec array<float>, error string").withColumnRenamed("key", key)


def valid_scores(results: list[dict], n: int) -> bool:
    """Whether a reranker's answer has unique indices in range and numbers as scores."""
    indices = [r.get("index") for r in results]
    return all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i < n for i in indices) and len(set(indices)) == len(indices) and all(isinstance(r.get("score"), (int, float)) and not isinstance(r.get("score"), bool) for r in results)


def rerank_scores(candidates: DataFrame, rerank: Callable[[str, list[str]], list[dict]], characters: int = 1500) -> DataFrame:
    """``qid, chunk_id, score, failed`` of ``qid, query, chunk_id, pos, text``.

    A query has at most as many candidates as fusion and expansion pass on (50 at
    the defaults), so a group is bounded.  A failed or invalid answer gives one row
    per candidate with a null score and ``failed``.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        scores: list[float | None] = [None] * len(frame)
        failed = False
        try:
            results = rerank(frame["query"].iloc[0], frame["text"].tolist())
            if not valid_scores(results, len(frame)):
                raise ValueError("invalid scores")
            for r in results:
                scores[r["index"]] = float(r["score"])
        except Exception:  # noqa: BLE001
            failed = True
        return pd.DataFrame({"qid": frame["qid"], "chunk_id": frame["chunk_id"], "score": pd.Series(scores, index=frame.index, dtype=float), "failed": failed})

    asked = candidates.select("qid", "query", "chunk_id", "pos", F.substring("text", 1, characters).alias("text"))
    return asked.groupBy("qid").applyInPandas(run, "qid string, chunk_id string, score double, failed boolean").withColumn("score", F.when(~F.isnan("score"), F.col("score")))


@dataclass(frozen=True)
class Endpoint:
    """A JSON endpoint; ``extra`` goes into every chat; errors never carry the key."""

    url: str
    model: str
    key: str = ""
    timeout: float = 30.0
    extra: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        if not 0 < self.timeout < math.inf:
            raise ValueError("timeout must be a number of seconds above 0")

    def post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body | {"model": self.model}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except Exception as problem:
            raise RuntimeError(f"{type(problem).__name__} at {path}") from None

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = sorted(self.post("/embeddings", {"input": texts})["data"], key=lambda d: d["index"])
        return [d["embedding"] for d in data]

    def rerank(self, query: str, texts: list[str]) -> list[dict]:
        results = self.post("/rerank", {"query": query, "documents": texts, "top_n": len(texts)})["results"]
        return [{"index": r.get("index"), "score": r.get("relevance_score")} for r in results]

    def chat(self, messages: list[dict], temperature: float = 0.2, most: int = 1024, **more: object) -> str:
        """The reply; ``extra`` of the endpoint and ``more`` of the call go into the body, those of the call first."""
        choices = self.post("/chat/completions", {"temperature": temperature, "max_tokens": most, **dict(self.extra), **more, "messages": messages}).get("choices") or []
        message = choices[0].get("message") if choices and isinstance(choices[0], dict) else None
        if not isinstance(message, dict) or not isinstance(message.get("content"), str | None):
            raise RuntimeError("an answer without a message")
        return message.get("content") or ""
