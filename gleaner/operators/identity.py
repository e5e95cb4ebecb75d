"""Content identity: dedup with aliases, revisions, observations, deletion; all set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import content_hash, stable_id, strip
from gleaner.functions.urls import uri_rank
from gleaner.session import stored


def content_documents(files: DataFrame) -> DataFrame:
    """Fresh build: one document for each (corpus_id, content hash), in ``seq`` order; empty texts are never merged.

    ``files``: corpus_id, uri, seq, text. Gives a row a file: document_id, content_hash, is_owner, canonical_uri, n_aliases.
    Hashes are written once, without the texts; the group aggregate and a join on the
    group key keep hot hashes out of a single sorted window.
    """
    empty = strip(F.coalesce("text", F.lit(""))) == ""
    rows = stored(files.select("corpus_id", "uri", "seq", F.when(empty, F.concat(F.lit("empty:"), "uri")).otherwise(content_hash("text")).alias("content_hash")), "hashes")
    groups = rows.groupBy("corpus_id", "content_hash").agg(F.min(F.struct("seq", "uri")).alias("first"), F.min(uri_rank("uri")).alias("best"), F.count(F.lit(1)).alias("n_aliases"))
    groups = groups.select("corpus_id", "content_hash", stable_id("document", "corpus_id", "first.uri").alias("document_id"), F.col("first.seq").alias("first_seq"), F.col("best.u").alias("canonical_uri"), "n_aliases")
    return rows.join(groups, ["corpus_id", "content_hash"]).select("corpus_id", "uri", "seq", "document_id", "content_hash", (F.col("seq") == F.col("first_seq")).alias("is_owner"), "canonical_uri", "n_aliases")


def primary_alias(aliases: DataFrame, group: str, uri: str = "uri") -> DataFrame:
    return aliases.groupBy(group).agg(F.min(uri_rank(uri)).alias("best"), F.count(F.lit(1)).alias("n_aliases")).select(group, F.col("best.u").alias("primary_uri"), "n_aliases")


def seeded_documents(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids of ``files`` (corpus_id, uri, content_hash, requested_id) given the aliases of the snapshot before.

    ``seeds``: corpus_id, uri, document_id, content_hash, is_owner. In order: the
    owner URL keeps its document if it is its only alias or the content is the
    same; another URL keeps its own sole document; else the lowest document with
    the same content; else the requested id, or a new one when the URL leaves a shared document.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("corpus_id", "document_id"))
    own = seeds.withColumn("n_aliases", n).select("corpus_id", "uri", F.col("document_id").alias("own_id"), F.col("content_hash").alias("own_hash"), "is_owner", "n_aliases")
    same = seeds.groupBy("corpus_id", "content_hash").agg(F.min("document_id").alias("same_id"))
    rows = files.join(own, ["corpus_id", "uri"], "left").join(same, ["corpus_id", "content_hash"], "left")
    empty = F.col("content_hash").isNull()
    alone = F.col("n_aliases") == 1
    split = stable_id("content-document", "corpus_id", "uri", "content_hash")
    choice = (
        F.when(empty, F.when(alone | F.col("is_owner"), F.col("own_id")).otherwise(F.col("requested_id")))
        .when(F.col("is_owner") & (alone | (F.col("own_hash") == F.col("content_hash"))), F.col("own_id"))
        .when(alone & F.col("same_id").isNull(), F.col("own_id"))
        .when(F.col("same_id").isNotNull(), F.col("same_id"))
        .when(F.col("own_id").isNotNull() & ~alone, split)
        .otherwise(F.col("requested_id"))
    )
    return rows.select("corpus_id", "uri", "content_hash", choice.alias("document_id"))


def revisions(rows: DataFrame) -> DataFrame:
    """Distinct revisions of each document, the first sight of each and which is current.

    ``rows``: document_id, content_hash, seq. A content seen again is the same revision; the last seen is current.
    """
    seen = rows.groupBy("document_id", "content_hash").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    last = seen.groupBy("document_id").agg(F.max("last_seq").alias("current_seq"))
    return seen.join(last, "document_id").select(stable_id("revision", "document_id", "content_hash").alias("revision_id"), "document_id", "content_hash", "first_seq", (F.col("last_seq") == F.col("current_seq")).alias("is_current"))


def observations(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every object between two runs; both have ``keys``, ``raw`` (bytes hash) and ``content`` (content hash)."""
    old = before.select(*keys, F.col("raw").alias("raw_0"), F.col("content").alias("content_0"), F.lit(True).alias("in_0"))
    new = now.select(*keys, F.col("raw").alias("raw_1"), F.col("content").alias("content_1"), F.lit(True).alias("in_1"))
    status = (
        F.when(F.col("in_0").isNull(), "added")
        .when(F.col("in_1").isNull(), "deleted")
        .when(~F.col("content_0").eqNullSafe(F.col("content_1")), "content_changed")
        .when(~F.col("raw_0").eqNullSafe(F.col("raw_1")), "metadata_only")
        .otherwise("unchanged")
    )
    return old.join(new, keys, "full_outer").select(*keys, status.alias("status"))


def after_deletion(aliases: DataFrame, deleted: DataFrame, group: str) -> DataFrame:
    """Aliases of each document after ``deleted`` URIs go: the new primary one, or the document deleted when none is left."""
    left = aliases.join(deleted.select("uri", F.lit(True).alias("gone")), "uri", "left")
    live = F.when(F.col("gone").isNull(), uri_rank("uri"))
    return left.groupBy(group).agg(F.min(live).alias("best"), F.count_if(F.col("gone").isNull()).alias("n_live")).select(group, F.col("best.u").alias("primary_uri"), "n_live", (F.col("n_live") == 0).alias("deleted"))


def identity_phase(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """Build order: owners of known documents, then other known URLs, then new ones; by URL rank within."""
    known = seeds.select("corpus_id", "uri", "is_owner")
    phase = F.when(F.col("is_owner"), 0).when(F.col("is_owner").isNotNull(), 1).otherwise(2)
    return files.join(known, ["corpus_id", "uri"], "left").withColumn("phase", phase).drop("is_owner").orderBy("phase", uri_rank("uri"))


def build_counters(files: DataFrame) -> DataFrame:
    """files_seen, documents_created, documents_unchanged, sections of a run; ``files``: created (boolean), sections."""
    return files.agg(F.count(F.lit(1)).alias("files_seen"), F.count_if("created").alias("documents_created"), F.count_if(~F.col("created")).alias("documents_unchanged"), F.sum(F.when(F.col("created"), F.col("sections")).otherwise(0)).alias("sections"))
