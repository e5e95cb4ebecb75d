"""Metadata filters, authorisation scope, visibility and lookups."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Scalar = str | int | float | bool | None


def _values(v) -> tuple:
    return tuple(v) if isinstance(v, (list, tuple)) else (v,)


def check_filters(filters: Mapping) -> None:
    for name, value in filters.items():
        if not isinstance(name, str) or not name.strip():
            raise ValueError("a filter needs a name")
        for v in _values(value):
            if v is not None and not isinstance(v, (str, int, float, bool)) or isinstance(v, float) and not math.isfinite(v):
                raise ValueError(f"filter {name}: only finite scalars")


def narrow_filters(authorized: Mapping, proposed: Mapping) -> dict:
    """The authorised filters narrowed by the proposed ones; widening is an error, new keys are allowed."""
    check_filters(authorized)
    check_filters(proposed)
    out = dict(authorized)
    for name, value in proposed.items():
        if name in authorized and not all(any(v == a and type(v) is type(a) for a in _values(authorized[name])) for v in _values(value)):
            raise PermissionError(f"filter {name} leaves the authorized scope")
        out[name] = value
    return out


def filter_column(filters: Mapping, of=F.col) -> Column:
    """Conjunction of null-safe equalities; a list is membership, an empty list matches nothing."""
    check_filters(filters)
    ok = F.lit(True)
    for name, value in filters.items():
        some = F.lit(False)
        for v in _values(value):
            some = some | of(name).eqNullSafe(F.lit(v))
        ok = ok & some
    return ok


def visible_chunks(chunks: DataFrame, documents: DataFrame, corpus_id: str | None = None, chunk_set_id: str | None = None) -> DataFrame:
    """Chunks whose document is not deleted and whose revision is the document's current one.

    ``documents``: document_id, current_revision_id, deleted_at, corpus_id. Corpus and chunk set prune the scans.
    """
    live = documents.where("deleted_at is null")
    if corpus_id is not None:
        live = live.where(F.col("corpus_id") == corpus_id)
    if chunk_set_id is not None:
        chunks = chunks.where(F.col("chunk_set_id") == chunk_set_id)
    return chunks.join(live.select("document_id", F.col("current_revision_id").alias("revision_id")), ["document_id", "revision_id"], "left_semi")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of an id set; repeated ids count once, an empty set gives nothing."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def unknown_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti")


def merged_metadata(meta, canonical: Mapping[str, Column]) -> Column:
    """Chunk metadata with the canonical columns on top; null canonical values do not hide what is there."""
    names = list(canonical)
    typed = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), canonical[n].cast("string"))]), lambda _, v: v.isNotNull())
    rest = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(typed, k))
    return F.map_concat(rest, typed)


def provenance_metadata(kind, url, strategy: str = "structural", extra: Mapping[str, Column] | None = None) -> Column:
    """Source family, host, path prefix, chunk strategy and the optional keys that have a value."""
    from gleaner.functions.urls import path_prefix, site_host
    from gleaner.sources.files import source_family

    parts = {"source_family": source_family(kind), "site_host": F.nullif(site_host(url), F.lit("")), "path_prefix": path_prefix(url), "chunk_strategy": F.lit(strategy), **(extra or {})}
    return F.map_filter(F.create_map(*[x for n, c in parts.items() for x in (F.lit(n), c.cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
