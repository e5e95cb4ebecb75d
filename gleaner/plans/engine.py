"""Corpus build and hybrid retrieval as lazily composed DataFrames."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from gleaner.functions.text import stable_id
from gleaner.operators import chunking, filters, identity, retrieve
from gleaner.functions.urls import uri_rank
from gleaner.operators.index import TextIndex, check_fingerprint, text_index
from gleaner.plans.profiles import Profile
from gleaner.session import stored

MOST_STAGES = 32


def former_aliases(tables: dict[str, DataFrame]) -> DataFrame:
    """Seeds of a rebuild from the tables of the snapshot before: corpus_id, uri, document_id, content_hash, is_owner."""
    current = tables["document_revisions"].where("is_current").select("document_id", "content_hash")
    return tables["document_aliases"].join(current, "document_id").select("corpus_id", F.col("canonical_uri").alias("uri"), "document_id", "content_hash", F.col("is_primary").alias("is_owner"))


def kept_identities(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """``placed`` (see ``identity.content_documents``) with the document ids that URLs and contents had before."""
    empty = F.col("content_hash").startswith("empty:")
    files = placed.select("corpus_id", "uri", F.when(~empty, F.col("content_hash")).alias("content_hash"), F.col("document_id").alias("requested_id")).distinct()
    chosen = identity.seeded_documents(files, seeds).select("corpus_id", "uri", F.coalesce("content_hash", F.concat(F.lit("empty:"), "uri")).alias("content_hash"), F.col("document_id").alias("kept"))
    rows = placed.join(chosen, ["corpus_id", "uri", "content_hash"]).drop("document_id", "is_owner", "canonical_uri", "n_aliases").withColumnRenamed("kept", "document_id")
    groups = rows.groupBy("corpus_id", "document_id", "content_hash").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_aliases"))
    primary = rows.groupBy("corpus_id", "document_id").agg(F.min(uri_rank("uri")).alias("best")).select("corpus_id", "document_id", F.col("best.u").alias("canonical_uri"))
    rows = rows.join(groups, ["corpus_id", "document_id", "content_hash"]).join(primary, ["corpus_id", "document_id"])
    return rows.withColumn("is_owner", F.col("seq") == F.col("first_seq")).drop("first_seq")


def build_corpus(files: DataFrame, corpus_id: str, profile: Profile, former: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """documents, document_revisions, document_aliases, chunks of ``files``: corpus_id, uri, seq, title, text (and sections).

    The first file of a content owns it; a URI seen again with another text adds a
    revision, the last one is current. With the tables of the snapshot before
    (``former``) URLs and contents keep their documents.
    """
    placed = identity.content_documents(files)
    if former is not None:
        placed = stored(kept_identities(placed, former_aliases(former)), "identities")
    full = files.join(placed.select("corpus_id", "uri", "seq", "document_id", "content_hash", "is_owner", "canonical_uri"), ["corpus_id", "uri", "seq"])
    owned = full.where("is_owner")
    seen = identity.revisions(owned.select("document_id", "content_hash", "seq"))
    keep = [c for c in ("sections",) if c in files.columns]
    texts = owned.select("document_id", "content_hash", "title", F.col("uri").alias("url"), "text", *keep).dropDuplicates(["document_id", "content_hash"])
    revisions = seen.join(texts, ["document_id", "content_hash"])
    current = seen.where("is_current").select("document_id", F.col("revision_id").alias("current_revision_id"))
    documents = placed.groupBy("corpus_id", "document_id").agg(F.min("canonical_uri").alias("canonical_uri")).join(current, "document_id").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    aliases = placed.select("corpus_id", F.col("uri").alias("canonical_uri"), "document_id", (F.col("uri") == F.col("canonical_uri")).alias("is_primary")).distinct()
    chunk_set = f"{corpus_id}-structural-{profile.digest[:12]}"
    chunks = chunking.chunk_rows(revisions, chunk_set, profile.chunking)
    return {"documents": documents, "document_revisions": revisions, "document_aliases": aliases, "chunks": chunks}


class Deadline:
    """Time left of a request; checked between stages."""

    def __init__(self, seconds: float | None = None):
        self.end = None if seconds is None else time.monotonic() + seconds

    def check(self, stage: str) -> None:
        if self.end is not None and time.monotonic() > self.end:
            raise TimeoutError(f"the deadline passed before {stage}")


@dataclass
class Retriever:
    """Hybrid retrieval under an authorised filter scope that calls can narrow only.

    ``chunks``: chunk_id, document_id, text and metadata columns, visible ones
    only. ``lanes``: further lanes by name, callables (queries, limit) -> ranked rows.
    """

    chunks: DataFrame
    index: TextIndex
    profile: Profile
    vectors: DataFrame | None = None
    authorized: Mapping = field(default_factory=dict)
    lanes: dict[str, Callable] = field(default_factory=dict)
    lane_weights: dict[str, float] = field(default_factory=dict)
    processor: Callable[[DataFrame], DataFrame] | None = None
    planner: Callable[[list[str]], list[tuple[str, int, float]]] | None = None
    embedder: str | None = None  # fingerprint of what embeds the queries
    vector_embedder: str | None = None  # and of what embedded the vectors

    def __post_init__(self) -> None:
        if self.vectors is not None and (self.embedder or self.vector_embedder):
            check_fingerprint(self.vector_embedder or "", self.embedder or "")
        if set(self.lanes) & {"dense", "sparse"} or len(self.lanes) > 14:
            raise ValueError("extra lanes need names of their own, at most 14")

    def planned(self, dense: bool) -> list[tuple[str, int, float]]:
        """(lane, limit, weight) of the lanes to ask, checked."""
        p = self.profile.retrieval
        known = ["sparse", *(["dense"] if dense else []), *self.lanes]
        default = {"sparse": (p.sparse_k, p.sparse_weight), "dense": (p.dense_k, p.dense_weight)}
        plan = self.planner(known) if self.planner else [(n, *default.get(n, (p.sparse_k, self.lane_weights.get(n, 1.0)))) for n in known]
        retrieve.check_lanes(plan, set(known))
        return plan

    def stages(self, queries: DataFrame, k: int = 8, proposed: Mapping | None = None, keep: bool = False, seconds: float | None = None) -> dict[str, DataFrame]:
        """Ranked rows of every stage; ``queries``: query_id, query, and embedding for the dense lane, allowed (optional).

        ``keep`` writes the lanes and the reranked rows, a few rows a query, so that reading several stages searches once.
        ``seconds`` is the time the request has; it is looked at between stages.
        """
        if isinstance(k, bool) or not 1 <= k <= 100:
            raise ValueError("k must be 1 to 100")
        deadline = Deadline(seconds)
        p = self.profile.retrieval
        scope = filters.narrow_filters(self.authorized, proposed or {})
        visible = self.chunks.where(filters.filter_column(scope)) if scope else self.chunks
        if "allowed" in queries.columns:
            queries = queries.where("allowed")
        queries = retrieve.checked_queries(queries)
        out: dict[str, DataFrame] = {}
        plan = self.planned(self.vectors is not None and "embedding" in queries.columns)
        for name, limit, _ in plan:
            deadline.check(name)
            if name == "sparse":
                rows = retrieve.sparse_lane(queries, self.index, visible if scope else None, limit, p.field_weights)
            elif name == "dense":
                vectors = self.vectors.join(visible.select("chunk_id"), "chunk_id", "left_semi")
                rows = retrieve.dense_lane(queries, vectors, limit)
            else:
                rows = self.lanes[name](queries, limit).join(visible.select("chunk_id"), "chunk_id", "left_semi")
            out[name] = stored(rows, f"lane-{name}") if keep else rows
        deadline.check("fused")
        fused = retrieve.rrf(out, {name: weight for name, _, weight in plan}, p.rrf_k)
        out["fused"] = fused
        if self.processor is not None:
            fused = retrieve.ranked(retrieve.only_given(self.processor(fused).select("query_id", "chunk_id", "score"), fused))
        top = fused.where(F.col("rank") <= p.rerank_input_k)
        content = visible.select("chunk_id", "document_id", "text")
        if p.reranker == "token_overlap":
            top = retrieve.token_overlap(top.select("query_id", "chunk_id").join(content, "chunk_id").join(queries.select("query_id", "query"), "query_id")).select("query_id", "chunk_id", "score", "rank")
        deadline.check("reranked")
        top = stored(top, "reranked") if keep else top
        out["reranked"] = top
        if p.mmr == "lexical":
            top = retrieve.mmr(top.join(content.select("chunk_id", "text"), "chunk_id"), min(k, p.final_k), p.mmr_lambda)
        elif p.mmr == "embedding":
            top = retrieve.mmr(top.join(self.vectors.select("chunk_id", "embedding"), "chunk_id"), min(k, p.final_k), p.mmr_lambda, "embedding")
        capped = retrieve.per_document_cap(top.join(content.select("chunk_id", "document_id"), "chunk_id"), p.max_chunks_per_doc, min(k, p.final_k))
        out["final"] = capped.select("query_id", "chunk_id", "score", "rank")
        return out

    def retrieve(self, queries: DataFrame, k: int = 8, proposed: Mapping | None = None, seconds: float | None = None) -> DataFrame:
        """The final rows with their chunks; evidence that is not there is an error."""
        final = self.stages(queries, k, proposed, seconds=seconds)["final"]
        return retrieve.resolved(final.withColumn("stage", F.lit("final")), self.chunks).drop("stage")

    def run_strategy(self, strategy: Callable, queries: DataFrame, proposed: Mapping | None = None) -> tuple[DataFrame, dict[str, DataFrame], dict[str, float]]:
        """A strategy owns the ranking; here it is only held to the scope and its bounds, and its evidence resolved."""
        scope = filters.narrow_filters(self.authorized, proposed or {})
        visible = self.chunks.where(filters.filter_column(scope)) if scope else self.chunks
        final, stages, numbers = strategy(retrieve.checked_queries(queries))
        if len(stages) > MOST_STAGES or len(numbers) > MOST_STAGES:
            raise ValueError(f"at most {MOST_STAGES} stages and {MOST_STAGES} diagnostics")
        if bad := [n for n, v in numbers.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v)]:
            raise ValueError(f"diagnostics that are no numbers: {', '.join(sorted(bad))}")
        return retrieve.resolved(final.withColumn("stage", F.lit("final")), visible).drop("stage"), stages, numbers


def stage_table(stages: dict[str, DataFrame]) -> DataFrame:
    """One long table (query_id, stage, rank, chunk_id, score)."""
    out = None
    for name, df in stages.items():
        rows = df.select("query_id", F.lit(name).alias("stage"), "rank", "chunk_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_chunks(documents: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Window chunks of a plain document table (doc_id, text, source): ids, ordinals, the source as title."""
    parts = documents.select("doc_id", "source", F.posexplode(chunking.char_windows("text", size, overlap)).alias("ordinal", "text")).where("text <> ''")
    return parts.select(stable_id("chunk", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("source").alias("title"), "text")


def chunk_index(chunks: DataFrame) -> TextIndex:
    return text_index(chunks, {"content": "text", "title": "title"}, keep=True)
