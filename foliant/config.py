"""Settings: defaults, then the user's file, the project's file and the environment, each over the ones before."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "FOLIANT_"


@dataclass(frozen=True)
class Config:
    level_1_size: int = 2048
    level_2_size: int = 512
    overlap: int = 256
    embedding_dim: int = 384
    top_k: int = 5
    threshold: float = 0.0
    data: str = "."
    output: str = "output"

    def with_values(self, values: dict) -> Config:
        """Known keys only, converted to the type of their default."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: known[k](v) for k, v in values.items() if k in known})


def load(user: Path | None = None, project: Path | None = None, environ: dict[str, str] | None = None) -> Config:
    out = Config()
    for path in (user, project):
        if path and path.exists():
            out = out.with_values(tomllib.loads(path.read_text()))
    env = os.environ if environ is None else environ
    return out.with_values({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})


def chunk_sizes(text: str) -> tuple[int, int, int]:
    """Three comma-separated numbers."""
    parts = [int(x) for x in text.split(",")]
    if len(parts) != 3 or min(parts) < 1:
        raise ValueError(f"three positive numbers are needed, not {text!r}")
    return parts[0], parts[1], parts[2]
