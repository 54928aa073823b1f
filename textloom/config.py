"""Settings with defaults, read from the environment (TEXTLOOM_<NAME>)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    prefetch: int = 50
    final: int = 5
    rrf_k: int = 60
    score_threshold: float = 0.6
    chunk_size: int = 2000
    chunk_overlap: int = 300
    window_tokens: int = 1000
    window_overlap: int = 150
    procedure_tokens: int = 450
    least_tokens: int = 20
    embed_batch: int = 16

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        given = {f.name: env.get(f"TEXTLOOM_{f.name.upper()}") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name] not in (None, "")})
