"""Settings with checked ranges, and feature flags."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

SECRET = ("password", "secret", "token", "key")


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    dimension: int = 1024
    similarity: str = "cosine"
    max_limit: int = 100
    vector_weight: float = 0.7
    embedding_batch: int = 50
    readme_limit: int = 50_000
    snippet_lines: int = 5
    commits_full: int = 100
    commits_incremental: int = 50
    api_key: str = ""

    def __post_init__(self):
        checks = {"dimension": self.dimension > 0, "similarity": self.similarity in ("cosine", "euclidean"), "max_limit": self.max_limit > 0, "vector_weight": 0 <= self.vector_weight <= 1, "snippet_lines": self.snippet_lines > 0}
        for name, good in checks.items():
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)!r}")

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Settings:
        """Settings from names in upper case; values are read as the type of the default."""
        found = {}
        for f in fields(cls):
            if (value := env.get(f.name.upper())) is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    def export(self) -> str:
        """JSON with secrets left out."""
        return json.dumps({k: "***" if any(s in k for s in SECRET) and v else v for k, v in asdict(self).items()}, sort_keys=True)


@dataclass(frozen=True)
class Flag:
    enabled: bool = True
    environments: frozenset[str] = frozenset()

    def on(self, environment: str) -> bool:
        return self.enabled and (not self.environments or environment in self.environments)


@dataclass
class Flags:
    """vector_search, hybrid_search, embeddings and batch_embeddings gate the operators of those names."""

    environment: str = "development"
    flags: dict[str, Flag] = field(default_factory=lambda: {n: Flag() for n in ("vector_search", "hybrid_search", "embeddings", "batch_embeddings")})

    def on(self, name: str) -> bool:
        return self.flags.get(name, Flag(False)).on(self.environment)

    def require(self, name: str) -> None:
        if not self.on(name):
            raise RuntimeError(f"{name} is switched off in {self.environment}")

    def totals(self) -> dict[str, int]:
        on = sum(self.on(n) for n in self.flags)
        return {"enabled": on, "disabled": len(self.flags) - on}


def read_env(lines: list[str]) -> dict[str, str]:
    """key=value lines; comments and lines without = are left out, one pair of quotes is taken off."""
    out = {}
    for line in map(str.strip, lines):
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out
