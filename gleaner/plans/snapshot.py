"""Immutable, versioned Parquet snapshots: staged, checked, committed by a manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA_VERSION = 3
#: Key of each table, and the foreign keys that must hold: column -> (table, column).
KEYS = {
    "corpora": ("corpus_id", {}),
    "documents": ("document_id", {"corpus_id": ("corpora", "corpus_id")}),
    "document_revisions": ("revision_id", {"document_id": ("documents", "document_id")}),
    "sections": ("section_id", {"revision_id": ("document_revisions", "revision_id")}),
    "chunk_sets": ("chunk_set_id", {"corpus_id": ("corpora", "corpus_id")}),
    "chunks": ("chunk_id", {"revision_id": ("document_revisions", "revision_id"), "chunk_set_id": ("chunk_sets", "chunk_set_id")}),
    "document_aliases": ("canonical_uri", {"document_id": ("documents", "document_id")}),
    "source_systems": ("source_system_id", {"corpus_id": ("corpora", "corpus_id")}),
    "source_objects": ("source_object_id", {"source_system_id": ("source_systems", "source_system_id")}),
    "source_observations": ("observation_id", {"source_object_id": ("source_objects", "source_object_id")}),
    "profile_snapshots": ("profile_digest", {}),
    "ingestion_runs": ("ingestion_run_id", {"corpus_id": ("corpora", "corpus_id")}),
    "index_runs": ("index_run_id", {"chunk_set_id": ("chunk_sets", "chunk_set_id")}),
}


def merged(old: DataFrame | None, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Upsert by key: the highest version of a key wins among the new rows, new rows win over old ones."""
    if version is not None:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), version).alias("r")).select("r.*")
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)


def violations(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Rows (table, rule, value) that break a key or a foreign key."""
    out = None
    for name, df in tables.items():
        key, foreign = KEYS.get(name, (None, {}))
        found = []
        if key and key in df.columns:
            found.append(df.groupBy(F.col(key).cast("string").alias("value")).count().where("count > 1 or value is null").select(F.lit(name).alias("table"), F.lit(f"unique {key}").alias("rule"), "value"))
        for c, (other, k) in foreign.items():
            if other in tables and c in df.columns:
                lost = df.select(F.col(c).alias(k)).where(F.col(k).isNotNull()).distinct().join(tables[other].select(k), k, "left_anti")
                found.append(lost.select(F.lit(name).alias("table"), F.lit(f"{c} in {other}").alias("rule"), F.col(k).cast("string").alias("value")))
        for f in found:
            out = f if out is None else out.unionByName(f)
    return out


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    path: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _files(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _listing(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files below a folder with their sizes, through the store's own client."""
    fs, p = _files(spark, path)
    top = fs.resolvePath(p).toUri().getPath().rstrip("/") + "/"
    out: dict[str, int] = {}
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toUri().getPath().removeprefix(top)
        if not any(part.startswith(("_", ".")) for part in name.split("/")) and name != "manifest.json":
            out[name] = f.getLen()
    return out


def _digests(spark: SparkSession, path: str) -> dict[str, str]:
    """sha256 of the data files, computed where they are read; names and digests only come to the driver, as many as the manifest lists."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", F.sha2("content", 256).alias("d"))
    top = _files(spark, path)[0].resolvePath(_files(spark, path)[1]).toUri().getPath().rstrip("/") + "/"
    return {urlsplit(r.path).path.removeprefix(top): r.d for r in rows.toLocalIterator()}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], stats: dict | None = None) -> Snapshot:
    """Write ``tables`` under ``root``: staged, checked for keys, renamed, and named by the digest of the manifest.

    The manifest holds the size and sha256 of every file, an index's included where its tables are given.
    """
    stage = f"{root}/_staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
    written = {name: spark.read.parquet(f"{stage}/{name}") for name in tables}
    fs, staged = _files(spark, stage)
    broken = violations(written)
    if broken is not None and (bad := broken.limit(5).collect()):
        fs.delete(staged, True)
        raise ValueError(f"constraints broken: {[tuple(r) for r in bad]}")
    listed, digests = _listing(spark, stage), _digests(spark, stage)
    body = {"app_schema_version": SCHEMA_VERSION, "tables": {n: sorted(df.dtypes) for n, df in written.items()}, "files": {n: [size, digests.get(n)] for n, size in listed.items()}, "stats": stats or {}}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    _write_text(spark, f"{stage}/manifest.json", json.dumps(body | {"digest": digest}, sort_keys=True))
    final = f"{root}/snapshot-{digest[:24]}"
    if not fs.rename(staged, _files(spark, final)[1]):
        raise OSError(f"{final} is there already")
    return open_snapshot(spark, final)


def open_snapshot(spark: SparkSession, path: str, verify: bool = False) -> Snapshot:
    """Open read-only; another schema version, another manifest or files of another size are refused, with ``verify`` also files of another digest."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first().value
    manifest = json.loads(text)
    body = {k: v for k, v in manifest.items() if k != "digest"}
    if body.get("app_schema_version") != SCHEMA_VERSION:
        raise ValueError("the snapshot has another schema version")
    if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != manifest.get("digest"):
        raise ValueError("the manifest was changed")
    files = _listing(spark, path)
    if files != {name: size for name, (size, _) in body["files"].items()}:
        raise ValueError("files of the snapshot were changed")
    if verify and _digests(spark, path) != {name: digest for name, (_, digest) in body["files"].items()}:
        raise ValueError("contents of the snapshot were changed")
    return Snapshot(spark, path, manifest)
