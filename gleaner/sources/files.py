"""Local mirrors as DataFrames: listing, type detection, decoding, source URLs, snapshot digest."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions.text import column

# The supported suffixes with the content type of each, MIME types likewise, and the family of each content type.
SUFFIXES = {
    ".html": "html",
    ".htm": "html",
    ".php": "html",
    ".pdf": "pdf",
    ".md": "markdown",
    ".markdown": "markdown",
    ".mdx": "markdown",
    ".txt": "text",
    ".rst": "text",
    ".docx": "word",
    ".pptx": "presentation",
    ".xlsx": "spreadsheet",
    ".csv": "spreadsheet",
    ".tsv": "spreadsheet",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".tif": "image",
    ".tiff": "image",
    ".webp": "image",
}
MIME = {
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/markdown": "markdown",
    "text/x-markdown": "markdown",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet",
    "text/csv": "spreadsheet",
    "text/tab-separated-values": "spreadsheet",
}
FAMILIES = {"html": "html", "pdf": "pdf", "markdown": "document", "text": "document", "word": "document", "presentation": "presentation", "spreadsheet": "spreadsheet", "image": "image"}


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(column(path), r"(\.[^./]+)$", 1))


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def content_type(path, mime=None) -> Column:
    """By suffix, else by MIME type without parameters, else ``unknown``."""
    by_suffix = F.when(suffix(path) != "", lookup(suffix(path), SUFFIXES))
    if mime is None:
        return F.coalesce(by_suffix, F.lit("unknown"))
    kind = F.lower(F.trim(F.split(column(mime), ";")[0]))
    by_mime = F.when(kind.isin(*MIME), lookup(kind, MIME)).when(kind.startswith("image/"), "image").when(kind.startswith("text/"), "text")
    return F.coalesce(by_suffix, by_mime, F.lit("unknown"))


def source_family(kind) -> Column:
    return F.coalesce(lookup(column(kind), FAMILIES), F.lit("unknown"))


def scan_mirror(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """path, relative_path, content, length of the supported files under ``root``; larger ones are left out at listing time."""
    root = os.path.realpath(root)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    relative = F.regexp_replace("path", r"^(?:file:)?/*" + "/" .join(map(_quoted, root.strip("/").split("/"))) + "/", "")
    return df.where(suffix("path").isin(*SUFFIXES)).select("path", relative.alias("relative_path"), "content", "length")


def _quoted(part: str) -> str:
    return r"\Q" + part + r"\E"


def decoded(content) -> Column:
    """UTF-8 (with or without mark), UTF-16, Windows-1252, else UTF-8 with replacement characters."""

    def batch(content: pd.Series) -> pd.Series:
    
        def one(b):
            if b is None:
                return None
            for charset in ("utf-8-sig", "utf-16", "cp1252"):
                try:
                    return bytes(b).decode(charset)
                except UnicodeDecodeError:
                    pass
            return bytes(b).decode("utf-8", "replace")
    
        return content.map(one)

    return F.pandas_udf(batch, "string")(column(content))


def mirror_url(relative_path, html, base_url: str | None = None) -> Column:
    """Where a mirrored file came from: its mirror comment, a host as first folder, or the base URL."""
    rel = column(relative_path)
    comment = F.regexp_extract(column(html), r"(?i)Mirrored\s+from\s+(?:https?://)?([^\s<>\"']+)", 1)
    scheme = F.when(F.regexp_extract(column(html), r"(?i)Mirrored\s+from\s+(https?://)", 1) != "", F.regexp_extract(column(html), r"(?i)Mirrored\s+from\s+(https?://)", 1)).otherwise("https://")
    first = F.split(rel, "/")[0]
    hosted = F.instr(rel, "/").cast("int") > 0
    is_host = hosted & first.contains(".") & ~suffix(first).isin(*SUFFIXES)
    plain = F.regexp_replace(rel, r"(^|/)index\.html?$", "$1")
    base = F.concat(F.lit(base_url.rstrip("/") + "/"), plain) if base_url else F.lit(None).cast("string")
    return F.when(suffix(rel).isin(".html", ".htm", ".php") & (comment != ""), F.concat(scheme, comment)).when(is_host, F.concat(F.lit("https://"), plain)).otherwise(base)


def snapshot_digest(files: DataFrame) -> str:
    """sha256 over the sorted (relative path, NUL, sha256 of the content, NUL); hashing is distributed, the fold takes paths and digests only."""
    rows = files.select("relative_path", F.unhex(F.sha2("content", 256)).alias("d")).orderBy("relative_path")
    out = hashlib.sha256()
    for r in rows.toLocalIterator():
        out.update(r.relative_path.encode() + b"\0" + bytes(r.d) + b"\0")
    return out.hexdigest()


def check_bindings(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every mismatch between an inventory and its explicit bindings: (relative_path, problem)."""
    have = files.select("relative_path", F.sha2("content", 256).alias("have"))
    want = bindings.select("relative_path", F.col("content_sha256").alias("want"), "source_uri")
    pairs = have.join(want, "relative_path", "full_outer")
    problem = F.when(F.col("want").isNull(), "not bound").when(F.col("have").isNull(), "missing file").when(F.col("have") != F.col("want"), "content differs")
    twice = bindings.groupBy("relative_path").count().where("count > 1").select("relative_path", F.lit("bound twice").alias("problem"))
    uris = bindings.groupBy("source_uri").agg(F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("relative_path")).where("n > 1").select("relative_path", F.lit("uri bound twice").alias("problem"))
    return pairs.select("relative_path", problem.alias("problem")).where("problem is not null").unionByName(twice).unionByName(uris)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by line; blank lines are skipped, anything else that fails to parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_eval_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation rows from JSON lines, a JSON array, or an object with ``cases``, ``results`` or ``items``."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    text = spark.read.text(path, wholetext=True)
    rows = F.coalesce(*[F.from_json(F.get_json_object("value", p), f"array<struct<{schema}>>") for p in ("$.cases", "$.results", "$.items")], F.from_json("value", f"array<struct<{schema}>>"))
    return text.select(F.inline(rows))
