"""python -m gleaner: build and evaluate corpora, check profiles."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession, functions as F

from gleaner.operators import evaluate, extract, pages
from gleaner.operators.index import index_tables, load_index, text_index
from gleaner.plans import engine, profiles, snapshot
from gleaner.session import ship, stored
from gleaner.sources import files

FIELDS = {"content": "text", "title": "title", "heading": "heading", "url": "url"}


def read_corpus(spark: SparkSession, root: str, corpus_id: str, base_url: str):
    """Mirrored HTML, Markdown, text and delimited files as build input; other formats need parsers that are not built in."""
    kind = F.when(files.suffix("relative_path").isin(".csv", ".tsv"), "table").otherwise(files.content_type("relative_path"))
    raw = files.scan_mirror(spark, root).withColumn("kind", kind).where(F.col("kind").isin("html", "markdown", "text", "table")).withColumn("raw", files.decoded("content"))
    stem = F.regexp_extract("relative_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    of = lambda k, x: F.when(F.col("kind") == k, x)
    separator = F.when(files.suffix("relative_path") == ".tsv", "\t").otherwise(",")
    # Python readers get the files of their kind only; the others are null there.
    parsed = raw.withColumn("page", pages.page_document(of("html", F.col("raw")))).withColumn("cells", extract.csv_markdown(of("table", F.col("raw")), separator)).withColumn("plain", extract.without_front_matter("raw"))
    body = F.array(F.struct(F.array(stem).alias("heading_path"), F.col("cells").alias("content"), F.lit(0).alias("start_char_idx"), F.length("cells").alias("end_char_idx")))
    sections = of("html", F.col("page.sections")).when(F.col("kind") == "markdown", extract.markdown_sections("plain")).when(F.col("kind") == "table", body).otherwise(extract.single_section(extract.plain_text("raw")))
    # Markdown without headings is one section.
    sections = F.when((F.col("kind") == "markdown") & (F.size(sections) == 0), extract.single_section(extract.markdown_text("plain"))).otherwise(sections)
    rows = parsed.withColumn("sections", sections)
    rows = rows.withColumn("text", F.when((F.col("kind") == "html") & (F.col("page.text") != ""), F.col("page.text")).otherwise(F.array_join(F.transform("sections", lambda s: s["content"]), "\n\n")))
    title = F.when(F.col("kind") == "html", extract.html_title("raw", stem)).otherwise(stem)
    # File names are unique, so their hash rank gives the build order without a global sort of contents.
    order = rows.select("relative_path").orderBy("relative_path").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    seq = spark.createDataFrame(order, "relative_path string, seq long")
    return rows.join(seq, "relative_path").select(F.lit(corpus_id).alias("corpus_id"), files.mirror_url("relative_path", "raw", base_url).alias("uri"), "seq", title.alias("title"), "text", "sections")


def with_fields(chunks):
    return chunks.withColumn("heading", F.array_join("heading_path", " > "))


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="gleaner")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="build a snapshot and its index from a mirror folder")
    build.add_argument("root")
    build.add_argument("output")
    build.add_argument("--corpus", default="corpus")
    build.add_argument("--base-url", default="https://localhost")
    build.add_argument("--profile")
    build.add_argument("--former", help="the snapshot before, whose document ids are kept")
    ask = sub.add_parser("evaluate", help="run a question file over a snapshot and print stage metrics")
    ask.add_argument("snapshot")
    ask.add_argument("dataset")
    ask.add_argument("--profile")
    ask.add_argument("-k", type=int, default=8)
    ask.add_argument("--output", help="folder for the metrics of every case and stage, as JSON lines")
    show = sub.add_parser("profile", help="resolve and check a profile")
    show.add_argument("path")
    args = top.parse_args(argv)
    if args.command == "profile":
        p = profiles.profile(profiles.resolve(args.path))
        print(json.dumps(dataclasses.asdict(p) | {"digest": p.digest}, indent=1))
        return
    spark = ship(SparkSession.builder.getOrCreate())
    p = profiles.profile(profiles.resolve(args.profile)) if args.profile else profiles.Profile("default")
    if args.command == "build":
        source = stored(read_corpus(spark, args.root, args.corpus, args.base_url), "files")
        names = ("document_aliases", "document_revisions")
        former = snapshot.open_snapshot(spark, args.former) if args.former else None
        tables = engine.build_corpus(source, args.corpus, p, {n: former.table(n) for n in names} if former else None)
        tables["chunks"] = stored(tables["chunks"], "chunks")
        tables |= index_tables(text_index(with_fields(tables["chunks"]), FIELDS, keep=True))
        snap = snapshot.commit(spark, args.output, tables, {"profile": p.digest})
        print(json.dumps({"snapshot": snap.path, "digest": snap.manifest["digest"]}))
        return
    snap = snapshot.open_snapshot(spark, args.snapshot)
    chunks = with_fields(snap.table("chunks"))
    cases = files.read_eval_rows(spark, args.dataset, "question string, question_id string, expected_chunk_ids array<string>, expected_doc_ids array<string>, expected_urls array<string>, expected_url_substrings array<string>")
    cases = cases.withColumn("case_id", F.coalesce("question_id", F.sha2("question", 256)))
    truth = evaluate.ground_truth(cases, chunks.select("document_id", "url").distinct()).select(F.col("case_id").alias("query_id"), "granularity", F.explode("relevant").alias("id"))
    run = engine.Retriever(chunks, load_index(spark, f"{snap.path}/index"), p)
    rows = engine.stage_table(run.stages(cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query")), args.k)).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    kinds = truth.select("query_id", "granularity").distinct()
    rows = rows.join(kinds, "query_id").withColumn("id", F.when(F.col("granularity") == "chunk", F.col("chunk_id")).otherwise(F.col("document_id")))
    metrics = evaluate.case_metrics(evaluate.deduplicated(rows, "id", args.k, ("stage", "query_id")), truth, args.k, "id", ("stage", "query_id"))
    if args.output:
        metrics.write.json(args.output)
    for r in evaluate.stage_summary(metrics).toJSON().collect():
        print(r)


if __name__ == "__main__":
    main()
