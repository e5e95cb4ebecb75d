"""Strict profiles: inheritance, external sections, deep merge, validation."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass, field

from gleaner.operators.chunking import Chunking
from gleaner.operators.index import FIELD_WEIGHTS


@dataclass(frozen=True)
class Retrieval:
    strategy: str = "hybrid"
    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    final_k: int = 8
    rerank_input_k: int = 50
    max_chunks_per_doc: int = 2
    reranker: str = "none"
    mmr: str = "none"
    mmr_lambda: float = 0.7
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    field_weights: dict = field(default_factory=lambda: dict(FIELD_WEIGHTS))

    def __post_init__(self) -> None:
        if not all(1 <= n <= 1000 for n in (self.dense_k, self.sparse_k, self.rerank_input_k)) or not 1 <= self.final_k <= 100 or self.rrf_k < 1 or self.max_chunks_per_doc < 0:
            raise ValueError("retrieval limits out of range")
        if self.reranker not in ("none", "token_overlap") or self.mmr not in ("none", "lexical", "embedding") or not 0 <= self.mmr_lambda <= 1:
            raise ValueError("unknown reranker or diversity mode")
        if not all(0 <= w <= 100 for w in (self.dense_weight, self.sparse_weight, *self.field_weights.values())):
            raise ValueError("weights must be 0 to 100")


@dataclass(frozen=True)
class Generation:
    max_context_chars: int = 16_000
    max_tokens: int = 1024
    timezone: str = "UTC"


@dataclass(frozen=True)
class Profile:
    profile_id: str
    schema_version: int = 3
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    generation: Generation = Generation()
    filters: dict = field(default_factory=dict)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()


def deep_merge(base: dict, over: dict) -> dict:
    """Maps merge, anything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(path: str, _seen: tuple[str, ...] = ()) -> dict:
    """A YAML profile with what it ``extends`` and its external ``sections``; cycles are an error."""
    import yaml

    path = os.path.realpath(path)
    if path in _seen:
        raise ValueError("profiles extend each other in a circle")
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data, dict):
        raise ValueError("a profile is a map")
    here = os.path.dirname(path)
    out: dict = {}
    parents = data.pop("extends", [])
    for parent in [parents] if isinstance(parents, str) else parents:
        out = deep_merge(out, resolve(os.path.join(here, parent), (*_seen, path)))
    for name, file in data.pop("sections", {}).items():
        out = deep_merge(out, {name: resolve(os.path.join(here, file), (*_seen, path))})
    return deep_merge(out, data)


def profile(data: dict) -> Profile:
    """Validated profile; unknown names are errors."""

    def build(kind, values: dict):
        known = {f.name: f for f in dataclasses.fields(kind)}
        if extra := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        nested = {"chunking": Chunking, "retrieval": Retrieval, "generation": Generation}
        return kind(**{k: build(nested[k], v) if k in nested and kind is Profile else v for k, v in values.items()})

    return build(Profile, data)
