"""Settings of an engine from the environment, checked when they are read."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from .operators.models import Endpoint


@dataclass(frozen=True)
class Config:
    corpus: str
    store: str
    dimensions: int
    embed: Endpoint
    rerank: Endpoint | None
    chat: Endpoint | None
    root_groups: tuple[str, ...]

    @classmethod
    def read(cls, environment: Mapping[str, str]) -> Config:
        """From ``VELDRA_*`` names; a missing folder or endpoint, a timeout that is no number above
        0 and an extra body that is no JSON object are errors."""
        get = lambda name, default="": environment.get(f"VELDRA_{name}", default).strip()
        lacking = [name for name in ("CORPUS", "STORE", "EMBED_URL", "EMBED_MODEL") if not get(name)]
        if lacking:
            raise ValueError("missing: " + ", ".join(f"VELDRA_{name}" for name in lacking))

        def endpoint(kind: str, timeout: str) -> Endpoint | None:
            if not get(f"{kind}_URL"):
                return None
            extra = json.loads(get(f"{kind}_EXTRA_BODY", "{}"))
            if not isinstance(extra, dict):
                raise ValueError(f"VELDRA_{kind}_EXTRA_BODY is no JSON object")
            return Endpoint(get(f"{kind}_URL"), get(f"{kind}_MODEL"), get(f"{kind}_KEY"), float(get(f"{kind}_TIMEOUT_SECONDS", timeout)), tuple(extra.items()))

        groups = tuple(g.strip() for g in get("ROOT_GROUPS").split(",") if g.strip())
        return cls(get("CORPUS"), get("STORE"), int(get("DIMENSIONS", "1024")), endpoint("EMBED", "30"), endpoint("RERANK", "10"), endpoint("CHAT", "120"), groups)
