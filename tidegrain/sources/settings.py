"""Settings in layers: defaults, a JSON file, the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Limits and defaults of the engine."""

    max_pages: int = 20
    max_depth: int = 2
    max_bytes: int = 4_000_000
    segment_bytes: int = 1200
    pacing_ms: int = 1000
    memory_limit: int = 5
    expand_limit: int = 3
    min_score: float = 0.15
    profile: str = "standard"

    def __post_init__(self) -> None:
        low = [f.name for f in fields(self) if f.type in ("int", "float") and getattr(self, f.name) < 0]
        if low:
            raise ValueError(f"settings below zero: {', '.join(low)}")
        if self.profile not in ("tiny", "standard", "deep"):
            raise ValueError(f"unknown profile: {self.profile}")


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Defaults, over them the file, over that TIDEGRAIN_<NAME> variables.

    Names that are not settings are ignored; values that don't convert raise.
    """
    environment = os.environ if environment is None else environment
    given = json.loads(Path(path).read_text()) if path else {}
    made = {}
    for f in fields(Settings):
        value = environment.get(f"TIDEGRAIN_{f.name.upper()}", given.get(f.name))
        if value is not None:
            made[f.name] = {"int": int, "float": float, "str": str}[f.type](value)
    return Settings(**made)
