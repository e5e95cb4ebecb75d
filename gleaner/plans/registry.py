"""Extension points: providers by capability and name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

API_VERSION = 2
# What a provider may offer.
CAPABILITIES = frozenset(
    (
        "retrieval",
        "strategy",
        "planner",
        "processor",
        "context",
        "artifact",
        "pdf",
        "pdf-inspector",
        "ocr",
        "prompt",
        "html",
        "policy",
        "chunker",
        "runtime",
    )
)


class Lane(Protocol):
    """Ranks chunks for queries: (query_id, query) -> (query_id, chunk_id, score, rank)."""

    def __call__(self, queries: DataFrame, limit: int) -> DataFrame: ...


class Processor(Protocol):
    """Reorders or drops candidates; ids it was not given are refused."""

    def __call__(self, ranked: DataFrame) -> DataFrame: ...


class ContextBuilder(Protocol):
    def __call__(self, final: DataFrame, chunks: DataFrame) -> DataFrame: ...


class Strategy(Protocol):
    """Owns the ranking of a request: (queries) -> (final rows, ranked rows by stage, numbers by name); the engine only checks and resolves what it returns."""

    def __call__(self, queries: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], dict[str, float]]: ...


class Planner(Protocol):
    """Chooses the lanes of a request: (lane, limit, weight) of each."""

    def __call__(self, lanes: list[str]) -> list[tuple[str, int, float]]: ...


class PromptSource(Protocol):
    def __call__(self, prompt_id: str) -> str: ...


class Policy(Protocol):
    """Adds a boolean ``allowed``; queries without it get nothing."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Provider:
    name: str
    version: str
    capabilities: frozenset[str]
    factory: Callable
    api_version: int = API_VERSION


@dataclass
class Registry:
    providers: dict[str, Provider] = field(default_factory=dict)

    def register(self, provider: Provider) -> None:
        if provider.api_version != API_VERSION:
            raise ValueError(f"{provider.name}: another API version")
        if provider.name in self.providers:
            raise ValueError(f"{provider.name} is registered already")
        if not provider.capabilities or provider.capabilities - CAPABILITIES:
            raise ValueError(f"{provider.name}: unknown capabilities")
        self.providers[provider.name] = provider

    def resolve(self, name: str, capability: str):
        p = self.providers.get(name)
        if p is None or capability not in p.capabilities:
            raise KeyError(f"no provider {name} for {capability}")
        return p.factory


def builtin() -> Registry:
    """What this package offers by itself; PDF, OCR and office parsers need their libraries and are not built in."""
    from gleaner.operators import chunking, pages, retrieve

    out = Registry()
    for name, capability, factory in (("sparse", "retrieval", retrieve.sparse_lane), ("dense", "retrieval", retrieve.dense_lane), ("canonical", "context", retrieve.resolved), ("neighbours", "context", retrieve.neighbours), ("html", "html", pages.page_document), ("structural", "chunker", chunking.structural_chunks)):
        out.register(Provider(name, "1", frozenset((capability,)), factory))
    return out
