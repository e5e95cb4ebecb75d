import math
import random
import sqlite3

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions import text as X
from gleaner.operators import answer, chunking, evaluate, extract, filters, identity, index, retrieve


def test_chunk_tables_repeat_their_header():
    head = "| name | value |\n| --- | --- |"
    text = head + "\n" + "\n".join(f"| row {k} with some more words in it | {k} |" for k in range(8))
    chunks = chunking.pack_blocks(text, chunking.Chunking(size=150, overlap=0))
    assert len(chunks) > 2 and all(c.startswith(head) and len(c) <= 150 for c in chunks)


def test_tiny_chunks():
    text = "x" * 95 + "\n\ny"
    make = lambda tiny: chunking.pack_blocks(text, chunking.Chunking(size=100, overlap=0, min_chars=10, tiny=tiny))
    assert make("drop") == ["x" * 95 + "\ny"] or make("drop") == ["x" * 95]
    big = "x" * 100 + "\n\ny"
    make = lambda tiny: chunking.pack_blocks(big, chunking.Chunking(size=100, overlap=0, min_chars=10, tiny=tiny))
    assert make("keep") == ["x" * 100, "y"] and make("drop") == ["x" * 100] and make("merge") == ["x" * 100, "y"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab |-\n1.", max_size=900), st.integers(100, 200), st.integers(0, 60))
def test_chunks_fit(text, size, overlap):
    chunks = chunking.pack_blocks(text, chunking.Chunking(size=size, overlap=overlap))
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(chunks).split()) == set(text.split()) or any(len(b) > size for b, _ in chunking._blocks(text, True))


def test_bad_chunking():
    for bad in ({"size": 50}, {"overlap": 1000}, {"tiny": "x"}, {"min_chars": 2000}):
        with pytest.raises(ValueError):
            chunking.Chunking(**bad)


def test_markdown(spark):
    md = "---\ntitle: x\n---\nlost\n# A\ntext *b* [l](u) ![i](v)\n## B\n- item\n\n\n\n> q &amp; r\n# C\n\n## D\nend"
    df = spark.createDataFrame([(md,), ("---\nopen",), (None,)], "x string")
    rows = [r[0] for r in df.select(extract.markdown_sections(extract.without_front_matter("x"))).collect()]
    assert [(s.heading_path, s.content) for s in rows[0]] == [(["A"], "text b l i"), (["A", "B"], "item\n\nq & r"), (["C", "D"], "end")]
    assert rows[1] == [] and rows[2] == []
    by_line = df.select(extract.line_sections("x")).first()[0]
    assert by_line[0].heading_path == [] and by_line[1].heading_path == ["A"] and by_line[1].start_char_idx == by_line[0].end_char_idx + 2


def test_tables():
    assert extract.table_markdown([["a", "b"], ["x|y"], ["1\n2", "3"]]) == "| a | b |\n| --- | --- |\n| x\\|y |  |\n| 1 2 | 3 |"


def test_csv(spark):
    got = spark.createDataFrame([('a,b\n"x, y",2',)], "x string").select(extract.csv_markdown("x", F.lit(","))).first()[0]
    assert got == "| a | b |\n| --- | --- |\n| x, y | 2 |"


def test_html_sections(spark):
    html = "<body><nav><p>menu</p></nav><p>intro</p><h1>T</h1><p>a <b>b</b></p><ul><li>one<ul><li>two</li></ul></li></ul><h3>S</h3><table><tr><th>h</th></tr><tr><td>v</td></tr></table><footer><p>no</p></footer>"
    rows = spark.createDataFrame([(html,)], "x string").select(extract.html_sections("x")).first()[0]
    assert [(s.heading_path, s.content) for s in rows] == [([], "intro"), (["T"], "a b\n- one\n- two"), (["T", "S"], "| h |\n| --- |\n| v |")]


def test_repeated_lines(spark):
    text = "Menu\nreal one\nMENU \n\nmenu\nShow menu\n" + "long line " * 10 + "\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.t for r in extract.deduped_lines(df, "k", "t").collect()}
    assert got == {1: "real one\n" + ("long line " * 10).strip(), 2: "", 3: ""}


def test_filters():
    auth = {"scope": ["public", "internal"]}
    assert filters.narrow_filters(auth, {"scope": "public", "lang": "en"}) == {"scope": "public", "lang": "en"}
    with pytest.raises(PermissionError):
        filters.narrow_filters(auth, {"scope": ["public", "secret"]})
    for bad in ({"": 1}, {"a": float("nan")}, {"a": {"b": 1}}):
        with pytest.raises(ValueError):
            filters.narrow_filters({}, bad)


def test_filter_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    keys = lambda f: sorted(r.k for r in df.where(filters.filter_column(f)).collect())
    assert keys({"v": None}) == [2] and keys({"v": ["a", None]}) == [1, 2] and keys({"v": []}) == [] and keys({}) == [1, 2, 3]


def test_visibility(spark):
    chunks = spark.createDataFrame([("c1", "d1", "r1"), ("c2", "d1", "r2"), ("c3", "d2", "r3")], "chunk_id string, document_id string, revision_id string")
    docs = spark.createDataFrame([("d1", "r2", None, "x"), ("d2", "r3", "2024", "x")], "document_id string, current_revision_id string, deleted_at string, corpus_id string")
    assert [r.chunk_id for r in filters.visible_chunks(chunks, docs, "x").collect()] == ["c2"]


FIELDS = {"content": "content", "title": "title", "heading": "heading", "url": "url"}
TEXTS = [("a", "orchid workshop in the garden", "Spring", "Plants", "x/orchid"), ("b", "violet violet registration", "Orchid", "", "x/b"), ("c", "garden the the", "Été naïve", "orchid violet", ""), ("d", "nothing here", "", "", ""), ("e", "more words for length and garden", "t", "h", "u"), ("f", "", "", "", "")]


def test_bm25_equals_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id UNINDEXED, content, title, heading, url)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?)", TEXTS)
    ix = index.text_index(spark.createDataFrame(TEXTS, "chunk_id string, content string, title string, heading string, url string"), FIELDS)
    queries = [("q1", "orchid garden"), ("q2", "violet violet the"), ("q3", "ETE naive"), ("q4", "absent")]
    got = {(r.query_id, r.chunk_id): r.score for r in retrieve.bm25_scores(spark.createDataFrame(queries, "query_id string, query string"), ix).collect()}
    want = {}
    for q, text in queries:
        match = " OR ".join(f'"{t}"' for t in text.split())
        for c, s in con.execute("SELECT chunk_id, -bm25(f, 0, 1, 5, 3, 2.5) FROM f WHERE f MATCH ?", (match,)):
            want[q, c] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_field_weights_flip_the_winner(spark):
    ix = index.text_index(spark.createDataFrame([("body", "orchid", "x"), ("head", "x", "orchid"), ("z", "y", "y"), ("w", "y", "y")], "chunk_id string, content string, title string"), {"content": "content", "title": "title"})
    q = spark.createDataFrame([(1, "orchid")], "query_id int, query string")
    best = lambda w: retrieve.sparse_lane(q, ix, None, 1, w).first().chunk_id
    assert best({"content": 10, "title": 1}) == "body" and best({"content": 1, "title": 10}) == "head"


RANKED = [(1, "a", "orchid workshop", 1.0, [1.0, 0.0]), (1, "b", "orchid workshop", 0.9, [1.0, 0.0]), (1, "c", "violet registration", 0.8, [0.0, 1.0])]


def test_rerank_and_diversity(spark):
    df = spark.createDataFrame(RANKED, "query_id int, chunk_id string, text string, score double, embedding array<double>")
    over = retrieve.token_overlap(df.drop("score").withColumn("query", F.lit("violet")))
    assert [r.chunk_id for r in over.orderBy("rank").collect()] == ["c", "a", "b"]
    for mode in ("lexical", "embedding"):
        assert [r.chunk_id for r in retrieve.mmr(df, 2, 0.1, mode).orderBy("rank").collect()] == ["a", "c"]
    items = df.select("query_id", F.when(F.col("chunk_id") == "c", 0).otherwise(1).alias("pos"), "chunk_id", F.array(F.lit(1.0), F.lit(1.0)).alias("q"), "embedding")
    assert [r.chunk_id for r in retrieve.mmr_items(items, 1).collect()] == ["c"]
    scored = retrieve.rerank_with(df.drop("score").withColumn("query", F.lit("x")), _lengths)
    assert scored.orderBy("rank").first().chunk_id == "c"


def _lengths(q, t):
    return t.str.len().astype(float)


_lengths.__annotations__ = {"q": __import__("pandas").Series, "t": __import__("pandas").Series, "return": __import__("pandas").Series}


def test_rrf(spark):
    lane = lambda ids: spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    best = retrieve.rrf({"dense": lane(["x"]), "sparse": lane(["y", "x"])}, {"dense": 10, "sparse": 1}, 20).orderBy("rank").first()
    assert best.chunk_id == "x" and math.isclose(best.score, 10 / 21 + 1 / 22, rel_tol=1e-9)
    twice = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3)], "query_id int, chunk_id string, rank int")
    assert {r.chunk_id: r.score for r in retrieve.rrf({"a": twice}).collect()}["y"] == round(1 / 62, 12)


def test_request_limits():
    retrieve.check_request("sparse", "q", 20, 1.0, {"sparse"})
    for bad in (("x", "q", 20, 1.0), ("sparse", " ", 20, 1.0), ("sparse", "q", True, 1.0), ("sparse", "q", 1001, 1.0), ("sparse", "q", 1, float("inf"))):
        with pytest.raises(ValueError):
            retrieve.check_request(*bad, {"sparse"})


def test_unknown_evidence_is_an_error(spark):
    ev = spark.createDataFrame([(1, "final", "nope", 1, 1.0)], "query_id int, stage string, chunk_id string, rank int, score double")
    with pytest.raises(Exception, match="unknown evidence"):
        retrieve.resolved(ev, spark.createDataFrame([("c",)], "chunk_id string")).collect()


def test_dense_lane_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(50)] + [(99, [0.0, 0.0, 0.0])], "chunk_id int, embedding array<double>")
    q = v.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    pairs = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "chunk_id", F.round(X.cosine("q", "embedding"), 6).alias("score"))
    assert key(retrieve.dense_lane(q, v, 7, block=2, decimals=6)) == key(retrieve.ranked(pairs, 7))


def test_seeded_identity(spark):
    seeds = spark.createDataFrame([("c", "u1", "d1", "h1", True), ("c", "u2", "d1", "h1", False), ("c", "u3", "d3", "h3", True)], "corpus_id string, uri string, document_id string, content_hash string, is_owner boolean")
    files = spark.createDataFrame([("c", "u1", "h1", "n"), ("c", "u2", "h9", "n"), ("c", "u3", "h4", "n"), ("c", "u4", "h3", "n"), ("c", "u5", "h5", "n5"), ("c", "u6", None, "n6")], "corpus_id string, uri string, content_hash string, requested_id string")
    got = {r.uri: r.document_id for r in identity.seeded_documents(files, seeds).collect()}
    assert got["u1"] == "d1" and got["u3"] == "d3" and got["u4"] == "d3" and got["u5"] == "n5" and got["u6"] == "n6" and got["u2"].startswith("gl_content_document_")


def test_observations(spark):
    schema = "k int, raw string, content string"
    before, now = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "a", "x")], schema), spark.createDataFrame([(2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "a", "x")], schema)
    assert {r.k: r.status for r in identity.observations(before, now, ["k"]).collect()} == {1: "deleted", 2: "unchanged", 3: "metadata_only", 4: "content_changed", 5: "added"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate("abcd")], "query_id int, document_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id int, document_id string")
    m = evaluate.case_metrics(ranked, truth, 3, cases=spark.createDataFrame([(1,), (2,)], "query_id int")).orderBy("query_id").collect()
    assert m[0].first_rank == 2 and math.isclose(m[0].recall, 1 / 3) and m[0].mrr == 0.5 and math.isclose(m[0].ap, 0.5 / 3)
    assert math.isclose(m[0].ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5)) and (m[0].hit_1, m[0].hit_3) == (0.0, 1.0)
    assert m[1].recall is None and m[1].n_rel == 0


def test_mixed_ground_truth_is_an_error(spark):
    cases = spark.createDataFrame([(1, ["c"], ["d"], None, None)], "case_id int, expected_chunk_ids array<string>, expected_doc_ids array<string>, expected_urls array<string>, expected_url_substrings array<string>")
    with pytest.raises(Exception, match="chunk and document signals"):
        evaluate.ground_truth(cases, spark.createDataFrame([("d", "u")], "document_id string, url string")).collect()


def test_answer_events():
    model = lambda out: lambda _: iter(out)
    events = list(answer.answer_events("q", [{"chunk_id": "c"}], "ctx", model(["It is ", "[C1]"])))
    assert [e["type"] for e in events] == ["status", "sources", "token", "token", "done"]
    assert list(answer.answer_events("q", [], "", model(["[C1]"])))[-1]["type"] == "error"


def greedy(rows, k, lam, similar):
    """(score, feature) by chunk; the chunks in order of choice."""
    top = max(abs(s) for s, _ in rows.values())
    out = []
    while len(out) < min(k, len(rows)):
        value = {c: lam * s / top - (1 - lam) * max((similar(x, rows[o][1]) for o in out), default=0) for c, (s, x) in rows.items() if c not in out}
        out.append(min(value, key=lambda c: (-value[c], c)))
    return out


@pytest.mark.parametrize("k", [8, 12, 40])
def test_mmr_against_a_plain_loop(spark, k):
    own = random.Random(k)
    rows = [(q, f"c{i:02}", " ".join(own.choices("ant bee cat dog elk fox gnu hen".split(), k=4)), own.random(), [own.gauss(0, 1) for _ in range(3)]) for q in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, text string, score double, embedding array<double>")
    jaccard = lambda a, b: len(a & b) / len(a | b)
    cosine = lambda a, b: math.sumprod(a, b) / (math.hypot(*a) * math.hypot(*b))
    for mode in ("lexical", "embedding"):
        got = retrieve.mmr(df, k, 0.5, mode).orderBy("query_id", "rank").collect()
        for q in range(3):
            mine = {c: (s, set(t.split()) if mode == "lexical" else e) for p, c, t, s, e in rows if p == q}
            assert [r.chunk_id for r in got if r.query_id == q] == greedy(mine, k, 0.5, jaccard if mode == "lexical" else cosine)


def test_mmr_lexical_is_registered_with_all_choices(spark):
    got = catalog.QUERIES["mmr_lexical_final"](spark, "/root/testdata/sf0.001").collect()
    assert max(r["rank"] for r in got) == 8
