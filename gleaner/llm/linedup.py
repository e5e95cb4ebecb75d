"""Cross-site line dedup by distinct-site spread.

A HyperLogLog sketch of the sites (``source``) is kept for each line hash and
merged by aggregation, map side first, so a line that a third of all rows carry
reaches its reducer once a task. Lines whose estimate is near the threshold get
an exact distinct count; the others are decided by the sketch, whose error at
``lg_k`` 10 is 3.3 %. A line found on at least ``min_sites`` sites is
boilerplate and removed everywhere but where it stands first (smallest doc_id,
then position), so copies of whole documents never vanish altogether.

Lines are compared without white space at their ends; blank lines are no
boilerplate and stay. A null text stays null, a null source is one more site.
Repeated rows count once for each row, of equal rows each keeps the first; a text
whose lines all go becomes empty; an empty table gives an empty result. A line of
a third of all rows is one key of the last join only where the boilerplate is
too large to broadcast; adaptive execution splits it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import fresh, materialize

MIN_SITES = 10
LG_K = 10
#: Estimates within these factors of the threshold are counted exactly.
NEAR = (0.7, 1.4)


def row_key() -> Column:
    """Tells rows apart when ids repeat or are null."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    line = F.btrim("line", F.lit(" \t\r"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("site"), row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(line != "")
        .select("doc_id", "site", "row", "pos", F.xxhash64(line).alias("key"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Keys of boilerplate lines, and where each stands first."""
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    spread = spread.where(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= NEAR[0] * min_sites)
    spread = materialize(spread, "line-spread")
    near = F.col("sites") < NEAR[1] * min_sites
    counted = lines.join(spread.where(near).select("key"), "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
    sure = spread.where(~near).select("key", "first")
    return sure.unionByName(spread.where(near).join(counted.where(F.col("exact") >= min_sites), "key").select("key", "first"))


def _marked(docs: DataFrame, min_sites: int, lg_k: int) -> tuple[DataFrame, str, list[Column]]:
    """``docs`` with a column more of the places of the lines to go, its name, and the columns of ``docs`` with the cleaned text."""
    lines = lines_of(docs)
    known = materialize(boilerplate(lines, min_sites, lg_k), "boilerplate")
    row, gone = fresh(docs, "_row"), fresh(docs, "_gone")
    hits = lines.join(known, "key").where(F.struct("doc_id", "row", "pos") != F.col("first")).groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return docs.withColumn(row, row_key()).join(hits, row, "left"), gone, [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with cleaned ``text`` and two columns more: ``n_lines``, ``n_removed`` (with a ``_`` added where ``docs`` has that name)."""
    out, gone, columns = _marked(docs, min_sites, lg_k)
    return out.select(
        *columns,
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias(fresh(docs, "n_lines")),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(fresh(docs, "n_removed")),
    )


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs``, all columns as they are but the cleaned ``text``."""
    out, _, columns = _marked(docs, min_sites, lg_k)
    return out.select(*columns)


def oracle(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS k, min((doc_id, pos)) AS first FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {min_sites}),
m AS (SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone FROM l LEFT JOIN s ON trim(l.line, ' ' || chr(9) || chr(13)) = s.k),
a AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.t, '') END AS text, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN a USING (doc_id)"""
