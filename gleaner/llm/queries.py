"""Queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm import bm25, linedup
from gleaner.llm.common import table
from gleaner.llm.decontam import leaks
from gleaner.llm.htmlmain import extract_main
from gleaner.llm.jaccard import similarity_components
from gleaner.llm.langid import identify
from gleaner.llm.packing import pack
from gleaner.llm.quality import quality
from gleaner.llm.spans import dedup_spans
from gleaner.llm.toxicity import toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"), within=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_line_dedup": op3_line_dedup,
    "op4_pack": op4_pack,
    "op5_bm25_topk": op5_bm25_topk,
    "op6_toxicity": op6_toxicity,
    "op7_html_main_text": op7_html_main_text,
    "op8_span_dedup": op8_span_dedup,
    "op9_quality": op9_quality,
    "op10_shingle_jaccard_join": op10_shingle_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": linedup.oracle(),
}
