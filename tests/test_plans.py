import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.plans import engine, profiles, registry, snapshot
from gleaner.operators import index
from gleaner.streaming import ingest


def corpus(spark):
    rows = [("c", "https://h/a?x", 0, "A", "same text"), ("c", "https://h/a", 1, "A", "same text "), ("c", "https://h/b", 2, "B", "orchid workshop details"), ("c", "https://h/e", 3, "E", ""), ("c", "https://h/f", 4, "F", "")]
    return spark.createDataFrame(rows, "corpus_id string, uri string, seq int, title string, text string")


def test_build_retrieve_and_commit(spark, tmp_path):
    profile = profiles.Profile("p")
    tables = engine.build_corpus(corpus(spark), "c", profile)
    docs = {r.canonical_uri: r for r in tables["documents"].collect()}
    assert set(docs) == {"https://h/a", "https://h/b", "https://h/e", "https://h/f"}
    aliases = {r.canonical_uri: r for r in tables["document_aliases"].collect()}
    assert aliases["https://h/a?x"].document_id == aliases["https://h/a"].document_id and aliases["https://h/a"].is_primary
    chunks = tables["chunks"].cache()
    assert sorted(r.text for r in chunks.collect()) == ["orchid workshop details", "same text"]
    ix = index.text_index(chunks, {"content": "text", "title": "title"})
    r = engine.Retriever(chunks, ix, profile, authorized={"title": ["A", "B"]})
    q = spark.createDataFrame([(1, "orchid"), (2, "text")], "query_id int, query string")
    assert {(x.query_id, x.title) for x in r.retrieve(q).collect()} == {(1, "B"), (2, "A")}
    assert r.retrieve(q, proposed={"title": "A"}).count() == 1
    with pytest.raises(PermissionError):
        r.stages(q, proposed={"title": "Z"})
    blocked = q.withColumn("allowed", F.col("query_id") == 1)
    assert {x.query_id for x in r.retrieve(blocked).collect()} == {1}
    tables = {k: v for k, v in tables.items() if k in ("documents", "document_revisions", "chunks")} | {"corpora": spark.createDataFrame([("c",)], "corpus_id string")}
    snap = snapshot.commit(spark, str(tmp_path), tables)
    again = snapshot.open_snapshot(spark, snap.path)
    assert again.table("chunks").count() == 2
    index.save_index(ix, f"{tmp_path}/index", 2)
    assert index.load_index(spark, f"{tmp_path}/index").fields == ("content", "title")


def test_broken_snapshots_are_refused(spark, tmp_path):
    bad = {"corpora": spark.createDataFrame([("c",), ("c",)], "corpus_id string"), "documents": spark.createDataFrame([("d", "x")], "document_id string, corpus_id string")}
    with pytest.raises(ValueError, match="constraints"):
        snapshot.commit(spark, str(tmp_path), bad)
    snap = snapshot.commit(spark, str(tmp_path), {"corpora": spark.createDataFrame([("c",)], "corpus_id string")})
    path = f"{snap.path}/manifest.json".removeprefix("file:")
    body = json.load(open(path))
    body["stats"] = {"x": 1}
    os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
    json.dump(body, open(path, "w"))
    with pytest.raises(ValueError, match="manifest"):
        snapshot.open_snapshot(spark, snap.path)


def test_merge(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int"), spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, ver int")
    assert sorted((r.k, r.v) for r in snapshot.merged(old, new, "k", "ver").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_profiles(tmp_path):
    (tmp_path / "base.yaml").write_text("profile_id: base\nretrieval:\n  dense_k: 5\n  final_k: 3\n")
    (tmp_path / "gen.yaml").write_text("max_context_chars: 99\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nprofile_id: own\nretrieval:\n  final_k: 4\nsections:\n  generation: gen.yaml\n")
    p = profiles.profile(profiles.resolve(str(tmp_path / "own.yaml")))
    assert (p.profile_id, p.retrieval.dense_k, p.retrieval.final_k, p.generation.max_context_chars) == ("own", 5, 4, 99)
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    with pytest.raises(ValueError):
        profiles.resolve(str(tmp_path / "loop.yaml"))
    for bad in ({"profile_id": "x", "foo": 1}, {"profile_id": "x", "retrieval": {"final_k": 0}}, {"profile_id": "x", "chunking": {"size": 1}}):
        with pytest.raises((ValueError, TypeError)):
            profiles.profile(bad)


def test_registry():
    r = registry.builtin()
    assert r.resolve("sparse", "retrieval")
    for bad in (registry.Provider("sparse", "1", frozenset(("retrieval",)), print), registry.Provider("x", "1", frozenset(("nope",)), print), registry.Provider("y", "1", frozenset(("ocr",)), print, 1)):
        with pytest.raises(ValueError):
            r.register(bad)
    with pytest.raises(KeyError):
        r.resolve("sparse", "ocr")


def test_incremental_stream(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a ", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")], "doc_id int, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.coalesce(1).write.parquet(src)
    stream = ingest.distinct_contents(ingest.new_documents(spark, src, "doc_id int, text string, ts timestamp"))
    q = ingest.upsert_stream(stream, lambda df, epoch: seen.extend(r.text.strip() for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a", "b"]


def test_entry_without_training_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
