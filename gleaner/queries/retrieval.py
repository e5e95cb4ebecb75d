"""Retrieval queries: index, lanes, fusion, reranking, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import text as X
from gleaner.operators import index, retrieve
from gleaner.plans.engine import Retriever, chunk_index, document_chunks, stage_table
from gleaner.plans.profiles import Profile, Retrieval
from gleaner.queries import Queries, table
from gleaner.session import spread, stored

ALL = Queries()

# DuckDB: window chunks of documents, their terms by field, and the index tables.
FOLD = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
WORDS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}\p{{Co}}]+')"
CHUNKS = """s AS (SELECT doc_id, source, text, unnest(range(0, length(text), 900)) AS s FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, source, s // 900 AS ordinal, trim(substr(text, s + 1, 1000), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM s),
chunks AS (SELECT 'gl_chunk_' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || CAST(ordinal AS VARCHAR)), 1, 24) AS chunk_id, doc_id, ordinal, source AS title, text FROM w WHERE text <> '')"""
INDEX = CHUNKS + f""",
tok AS (SELECT chunk_id, 'content' AS field, unnest({WORDS.format('text')}) AS term FROM chunks UNION ALL SELECT chunk_id, 'title', unnest({WORDS.format('title')}) FROM chunks),
len AS (SELECT c.chunk_id, count(t.term) AS dl FROM chunks c LEFT JOIN tok t USING (chunk_id) GROUP BY 1),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(CAST(dl AS DOUBLE)) AS avgdl FROM len),
post AS (SELECT term, chunk_id, count(*) FILTER (field = 'content') AS tf_content, count(*) FILTER (field = 'title') AS tf_title FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""


def bm25_sql(wc: float = 1.0, wt: float = 5.0, table: str = "scores") -> str:
    return INDEX + f""",
qt AS (SELECT item_id AS query_id, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
p AS (SELECT query_id, chunk_id, qtf * idf AS w, {wc} * tf_content + {wt} * tf_title AS f, CAST(dl AS DOUBLE) AS dl FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (chunk_id)),
{table} AS (SELECT query_id, chunk_id, round(sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p, st GROUP BY ALL)"""


def top(table: str, n: int, extra: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {table} {extra} QUALIFY rank <= {n}"


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_indexes: dict[tuple, tuple] = {}


def index_of(spark: SparkSession, sf: str):
    """Chunks and their index, built once for a snapshot of the documents in an application."""
    docs = table(spark, sf, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, sf, state)
    if key in _indexes:
        try:
            _indexes[key][1].lengths.limit(1).collect()  # the folder may have been cleared since
        except Exception:
            del _indexes[key]
    if key not in _indexes:
        chunks = stored(document_chunks(spread(docs.select("doc_id", "source", "text"))), "chunks")
        _indexes[key] = chunks, chunk_index(chunks)
    return _indexes[key]


def scored(df: DataFrame) -> DataFrame:
    """Scores rounded for comparison, after ranking."""
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


OUT = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM t"


@ALL.add(f"WITH {INDEX} SELECT term, count(*) AS df, CAST(sum(tf_content) AS BIGINT) AS tf_content, CAST(sum(tf_title) AS BIGINT) AS tf_title FROM post GROUP BY 1")
def postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, ix = index_of(spark, sf)
    return ix.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf_content").alias("tf_content"), F.sum("tf_title").alias("tf_title"))


@ALL.add(f"WITH {bm25_sql(1.0, 0.0)}, t AS ({top('scores', 10)}) {OUT}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, ix = index_of(spark, sf)
    return scored(retrieve.sparse_lane(queries_of(spark, sf), ix, limit=10, weights={"content": 1.0, "title": 0.0}))


@ALL.add(f"WITH {bm25_sql(1.0, 5.0)}, t AS ({top('scores', 20)}) {OUT}")
def bm25_multifield(spark: SparkSession, sf: str) -> DataFrame:
    _, ix = index_of(spark, sf)
    return scored(retrieve.sparse_lane(queries_of(spark, sf), ix, limit=20))


@ALL.add(f"WITH {bm25_sql(1.0, 5.0)}, v AS (SELECT chunk_id FROM chunks JOIN documents USING (doc_id) WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')), f AS (SELECT * FROM scores WHERE chunk_id IN (SELECT chunk_id FROM v)), t AS ({top('f', 10)}) {OUT}")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ix = index_of(spark, sf)
    ok = table(spark, sf, "documents").where("lang = 'en' AND source IN ('src1', 'src2', 'src3')").select(F.col("doc_id").alias("document_id"))
    return scored(retrieve.sparse_lane(queries_of(spark, sf), ix, chunks.join(ok, "document_id", "left_semi"), 10))


COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
DENSE = f"q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), scores AS (SELECT q.query_id, v.vec_id AS chunk_id, v.label, round({COS}, 6) AS score FROM q, embeddings v)"


def vectors_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@ALL.add(f"WITH {DENSE}, t AS ({top('scores', 20)}) SELECT query_id, chunk_id, score, rank FROM t")
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, v = vectors_of(spark, sf)
    return scored(retrieve.dense_lane(q, v, 20, decimals=6))


@ALL.add(f"WITH {DENSE}, f AS (SELECT * FROM scores WHERE label IN (1, 2, 3)), t AS ({top('f', 10)}) SELECT query_id, chunk_id, score, rank FROM t")
def dense_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, v = vectors_of(spark, sf)
    return scored(retrieve.dense_lane(q, v.where(F.col("label").isin(1, 2, 3)), 10, decimals=6))


@ALL.add("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM e)
SELECT vec_id, round(norm, 6) AS norm, CAST(unnest(range(len(x))) AS INTEGER) AS pos, round(unnest(list_transform(x, lambda v: CASE WHEN norm = 0 THEN v ELSE v / norm END)), 6) AS x FROM n""")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Every number of every vector."""
    e = index.vector_table(table(spark, sf, "embeddings"))
    return e.select("vec_id", F.round("norm", 6).alias("norm"), F.posexplode(X.l2_normalized("embedding")).alias("pos", "x")).withColumn("x", F.round("x", 6))


@ALL.add("""WITH d AS (SELECT item_id, sha256('7' || chr(0) || 'query' || chr(0) || text || chr(0) || '0') AS h FROM benchmark), n AS (SELECT item_id, list_transform(range(8), lambda j: CAST(('0x' || substr(h, CAST(j * 8 + 1 AS BIGINT), 8)) AS BIGINT) / 2147483647.5 - 1) AS x FROM d)
SELECT item_id, CAST(unnest(range(8)) AS INTEGER) AS pos, round(unnest(list_transform(x, lambda v: v / sqrt(list_inner_product(x, x)))), 6) AS x FROM n""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = X.hash_embedding("text", 8, 7, "query")
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(e).alias("pos", "x")).withColumn("x", F.round("x", 6))


TITLE_LANE = bm25_sql(1.0, 5.0) + ", a AS (" + top("scores", 20) + ")"


def two_lanes(spark: SparkSession, sf: str):
    chunks, ix = index_of(spark, sf)
    q = queries_of(spark, sf)
    sparse = stored(retrieve.sparse_lane(q, ix, limit=20), "sparse-lane")
    overlap = retrieve.token_overlap(sparse.select("query_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(q, "query_id"))
    return chunks, q, sparse, overlap.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


FOLDED = r"list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'))"
OVERLAP = f"""o0 AS (SELECT a.query_id, a.chunk_id, len(list_intersect({FOLDED.format('b.text')}, {FOLDED.format('c.text')})) / greatest(len({FOLDED.format('b.text')}), 1) AS score FROM a JOIN benchmark b ON b.item_id = a.query_id JOIN chunks c USING (chunk_id)), o AS ({top('o0', 1000)})"""


@ALL.add(f"WITH {TITLE_LANE}, {OVERLAP}, t AS (SELECT * FROM o) {OUT}")
def token_overlap_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return scored(two_lanes(spark, sf)[3])


def rrf_sql(w1: float, w2: float, k: int) -> str:
    return f"f0 AS (SELECT query_id, chunk_id, round(sum(s), 12) AS score FROM (SELECT query_id, chunk_id, {w1}::DOUBLE / ({k} + rank) AS s FROM a UNION ALL SELECT query_id, chunk_id, {w2}::DOUBLE / ({k} + rank) FROM o) GROUP BY ALL), fused AS ({top('f0', 100000)})"


@ALL.add(f"WITH {TITLE_LANE}, {OVERLAP}, {rrf_sql(1, 1, 60)}, t AS (SELECT * FROM fused) {OUT}")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    _, _, a, b = two_lanes(spark, sf)
    return scored(retrieve.rrf({"sparse": a, "overlap": b}))


@ALL.add(f"WITH {TITLE_LANE}, {OVERLAP}, {rrf_sql(10, 0.5, 20)}, t AS (SELECT * FROM fused) {OUT}")
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    _, _, a, b = two_lanes(spark, sf)
    return scored(retrieve.rrf({"sparse": a, "overlap": b}, {"sparse": 10.0, "overlap": 0.5}, 20))


@ALL.add(f"""WITH {TITLE_LANE}, {OVERLAP}, l AS (SELECT query_id, c.doc_id AS chunk_id, 0 AS list_no, rank FROM a JOIN chunks c USING (chunk_id) UNION ALL SELECT query_id, c.doc_id, 1, rank FROM o JOIN chunks c USING (chunk_id)),
f AS (SELECT query_id, chunk_id, round(sum(CASE list_no WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 12) AS score, min((list_no, rank)) AS seen FROM l GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM f""")
def rrf_item_lists(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _, a, b = two_lanes(spark, sf)
    of = chunks.select("chunk_id", "document_id")
    lists = a.select("query_id", "chunk_id", "rank", F.lit(0).alias("list_no")).unionByName(b.select("query_id", "chunk_id", "rank", F.lit(1).alias("list_no"))).join(of, "chunk_id")
    return scored(retrieve.rrf_items(lists.select("query_id", "list_no", "rank", F.col("document_id").alias("chunk_id")), {1: 2.0}))


CAPPED = """capped AS (SELECT {0}.*, c.doc_id, row_number() OVER (PARTITION BY query_id, c.doc_id ORDER BY rank) AS nth FROM {0} JOIN chunks c USING (chunk_id)), t AS (SELECT query_id, chunk_id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM capped WHERE nth <= 2) WHERE k <= 8)"""


@ALL.add(f"WITH {TITLE_LANE}, {CAPPED.format('a')} {OUT}")
def per_doc_cap(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _, a, _ = two_lanes(spark, sf)
    return scored(retrieve.per_document_cap(a.join(chunks.select("chunk_id", "document_id"), "chunk_id")))


PROFILE = Profile("flagship", retrieval=Retrieval(reranker="token_overlap"))


def flagship(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Two lanes over one index: the weighted fields, and the text alone."""
    chunks, ix = index_of(spark, sf)
    plain = lambda q, n: retrieve.sparse_lane(q, ix, limit=n, weights={"content": 1.0, "title": 0.0})
    engine = Retriever(chunks, ix, PROFILE, lanes={"plain": plain})
    return engine.stages(queries_of(spark, sf), keep=True)


HYBRID = (
    bm25_sql(1.0, 5.0)
    + f""", p2 AS (SELECT query_id, chunk_id, w, CAST(tf_content AS DOUBLE) AS f, dl FROM (SELECT query_id, chunk_id, qtf * idf AS w, tf_content, CAST(dl AS DOUBLE) AS dl FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (chunk_id))),
plain0 AS (SELECT query_id, chunk_id, round(sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p2, st GROUP BY ALL),
a AS ({top('scores', 20)}), b AS ({top('plain0', 20)}),
f0 AS (SELECT query_id, chunk_id, round(sum(s), 12) AS score FROM (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM b) GROUP BY ALL), fused AS ({top('f0', 100000)}),
r0 AS (SELECT f.query_id, f.chunk_id, len(list_intersect({FOLDED.format('q.text')}, {FOLDED.format('c.text')})) / greatest(len({FOLDED.format('q.text')}), 1) AS score FROM fused f JOIN benchmark q ON q.item_id = f.query_id JOIN chunks c USING (chunk_id) WHERE f.rank <= 50), reranked AS ({top('r0', 1000)}),
{CAPPED.format('reranked')}"""
)


@ALL.add(f"WITH {HYBRID} {OUT}")
def hybrid_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return scored(flagship(spark, sf)["final"])


@ALL.add(f"WITH {HYBRID} SELECT stage, count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT 'sparse' AS stage, query_id FROM a UNION ALL SELECT 'plain', query_id FROM b UNION ALL SELECT 'fused', query_id FROM fused UNION ALL SELECT 'reranked', query_id FROM reranked UNION ALL SELECT 'final', query_id FROM t) GROUP BY 1")
def stage_recording(spark: SparkSession, sf: str) -> DataFrame:
    return stage_table(flagship(spark, sf)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"))


JACCARD = "len(list_intersect(x.w, y.w)) / CAST(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS DOUBLE)"


@ALL.add(f"""WITH {TITLE_LANE}, mm AS (SELECT a.query_id, a.chunk_id, a.score / max(abs(a.score)) OVER (PARTITION BY a.query_id) AS rel, {FOLDED.format('c.text')} AS w FROM a JOIN chunks c USING (chunk_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS pick FROM mm QUALIFY pick = 1),
y AS (SELECT y.query_id, y.chunk_id, row_number() OVER (PARTITION BY y.query_id ORDER BY 0.7 * y.rel - (1 - 0.7) * ({JACCARD}) DESC, y.chunk_id) AS nxt FROM mm y JOIN x USING (query_id) WHERE y.chunk_id <> x.chunk_id QUALIFY nxt = 1)
SELECT query_id, chunk_id, CAST(1 AS INTEGER) AS rank FROM x UNION ALL SELECT query_id, chunk_id, CAST(2 AS INTEGER) FROM y""")
def mmr_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The first two choices, which SQL can say without recursion."""
    chunks, _, a, _ = two_lanes(spark, sf)
    return retrieve.mmr(a.join(chunks.select("chunk_id", "text"), "chunk_id"), 2).select("query_id", "chunk_id", "rank")


@ALL.add(None)
def mmr_lexical_final(spark: SparkSession, sf: str) -> DataFrame:
    """Rows-only: all choices of the profile's ``final_k``; tested against a plain loop."""
    chunks, _, a, _ = two_lanes(spark, sf)
    return retrieve.mmr(a.join(chunks.select("chunk_id", "text"), "chunk_id"), PROFILE.retrieval.final_k).select("query_id", "chunk_id", "rank")


@ALL.add(None)
def mmr_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Rows-only: greedy selection over dense candidates; tested against a plain loop."""
    q, v = vectors_of(spark, sf)
    return retrieve.mmr(retrieve.dense_lane(q, v, 20).join(v.select("chunk_id", "embedding"), "chunk_id"), 8, mode="embedding").select("query_id", "chunk_id", "rank")


@ALL.add(f"WITH {TITLE_LANE}, k AS (SELECT a.query_id, a.rank, c.doc_id, c.ordinal FROM a JOIN chunks c USING (chunk_id)) SELECT k.query_id, c.chunk_id, min(k.rank) AS rank FROM k JOIN chunks c ON c.doc_id = k.doc_id AND c.ordinal BETWEEN k.ordinal - 1 AND k.ordinal + 1 GROUP BY ALL")
def context_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _, a, _ = two_lanes(spark, sf)
    return retrieve.neighbours(a, chunks.withColumn("revision_id", F.col("document_id"))).withColumn("rank", F.col("rank").cast("long"))


@ALL.add(f"WITH {TITLE_LANE} SELECT a.query_id, a.chunk_id, a.rank, c.doc_id AS document_id, c.title FROM a JOIN chunks c USING (chunk_id)")
def evidence_resolve(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _, a, _ = two_lanes(spark, sf)
    twice = a.unionByName(a.withColumn("rank", F.col("rank") + 100)).withColumn("stage", F.lit("sparse"))
    return retrieve.resolved(twice, chunks).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "document_id", "title")
