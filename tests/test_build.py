"""Build formats, kept identities, digests, dense index runs, guards of the engine, prompts."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner import __main__ as main
from gleaner.functions import text as X
from gleaner.operators import chunking, evaluate, extract, index, pages, retrieve
from gleaner.plans import engine, profiles, prompts, registry, snapshot


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


PAGE = """<html><head><title>T</title></head><body><nav><p>menu</p></nav><div class="promo big"><p>buy</p></div><p data-kind="Advert-1">ad</p>
<main><h1>Orchids</h1><p>Write to ann (at) plants dot example or call 0612345678, please.</p><ul><li>one<ul><li>inner</li></ul></li></ul>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr></table></main><footer><p>foot</p></footer></body></html>"""


def test_body_text_and_selectors():
    rules = (pages.AttributeRule("data-kind", "^advert"),)
    text = pages.body_text(pages.without(pages.tree(PAGE), rules=rules))
    assert text == "Orchids\nWrite to ann@plants.example or call 06 12 34 56 78, please.\none inner\na | b\n1"
    whole = pages.body_text(pages.without(pages.tree("<p>x</p><p data-kind='ADVERT'>y</p><div class='promo big'><p>z</p></div><table><tr><td>c</td></tr></table>"), (*pages.REMOVED, "div.promo", "[hidden]", "#id"), rules, tables=False))
    assert whole == "x"
    with pytest.raises(ValueError):
        pages.selects("div > p")


def test_page_document(spark):
    got = one(spark, PAGE, pages.page_document("x", (*pages.REMOVED, ".promo")))
    own = {tuple(s.heading_path): s.content for s in got.sections}
    assert own[()] == "ad" and "ann@plants.example" in own[("Orchids",)]
    plain = one(spark, "<div>no block</div><p>only a line</p>", pages.page_document("x"))
    assert [s.content for s in plain.sections] == ["only a line"] and one(spark, None, pages.page_document("x")).text == ""


def test_addresses_and_numbers(spark):
    mail = lambda s: one(spark, s, X.deobfuscated_email("x"))
    assert mail("a at b" + "".join(f" dot {c}" for c in "cdefghi")) == "a@b.c.d.e.f.g.h.i"
    assert mail("jane@anecdotes.com is no riddle") == "jane@anecdotes.com is no riddle"
    assert mail("write to me@x.com, dot your i, look at it") == "write to me@x.com, dot your i, look at it"
    assert mail("Jo [AT] ex (DOT) org and x chez y point fr") == "Jo@ex.org and x@y.fr" and mail(None) is None
    assert one(spark, "ring +33 6 12 34 56 or 06.12.34.56.78", X.phone_pairs("x")).startswith("ring ")
    assert one(spark, "06.12.34.56.78", X.phone_pairs("x")) == "06 12 34 56 78" and one(spark, "0612345", X.phone_pairs("x")) == "0612345"


def test_composed_texts_are_one_document(spark):
    assert one(spark, "été", X.content_hash("x")) == one(spark, "été", X.content_hash("x")) == hashlib.sha256("été".encode()).hexdigest()
    assert one(spark, "őr ş é ß", X.folded("x")) == "or s e ß"


def test_blocks(spark):
    blocks = F.array(*[F.struct(F.lit(h).cast("string").alias("heading"), F.lit(v).alias("value")) for h, v in (("A", " one *b* "), (None, "two"), ("C", "  "), ("D", "three"))])
    got = one(spark, "", extract.block_document(blocks))
    assert got.markdown == "## A\n\none *b*\n\ntwo\n\n## D\n\nthree"
    assert [(s.heading_path, s.content, got.markdown[s.start_char_idx : s.end_char_idx]) for s in got.sections] == [(["A"], "one b", "one *b*"), ([], "two", "two"), (["D"], "three", "three")]


def test_windows_and_segments_against_plain(spark):
    text = "".join(chr(97 + k % 26) if k % 7 else "é" for k in range(5003)) + "\U0001f600 \n"
    want = [text[k : k + 1000].strip() for k in range(0, len(text), 900)]
    assert one(spark, text, chunking.char_windows("x")) == want
    assert one(spark, text, chunking.char_windows("x", 300, 250)) == [text[k : k + 300].strip() for k in range(0, len(text), 50)]
    assert one(spark, "", chunking.char_windows("x")) == []
    rows = spark.createDataFrame([(1, "a\nb\n\n- l\n| t |\n|u|\nc"), (1, "z"), (2, None), (3, "")], "k int, text string")
    got = sorted((r.k, r.ordinal, r.kind, r.content) for r in chunking.block_segments(rows, "k", "text").collect())
    assert got == [(1, 0, "paragraph", "a\nb"), (1, 0, "paragraph", "z"), (1, 1, "list", "- l"), (1, 2, "table", "| t |"), (1, 3, "table", "|u|"), (1, 4, "paragraph", "c")]


def test_repeated_lines_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "x\nX \ny\n x\nlong " + "w" * 90 + "\n" + "\n".join(["long " + "w" * 90] * 2)), (1, "x\nShow  Menu\nz"), (2, None)], "k int, text string")
    got = sorted((r.k, r.text, r.n_lines) for r in extract.deduped_lines(rows, "k", "text").collect())
    long = "long " + "w" * 90
    assert got == [(1, "x\nz", 2), (1, "\n".join(["y", long, long, long]), 4), (2, "", 0)]


def test_passage_truth_against_contains(spark):
    docs = spark.createDataFrame([(k, f"w{k} alpha beta gamma delta epsilon zeta{k % 3} end short") for k in range(30)] + [(99, "alpha  beta gamma delta epsilon zeta1 end")], "document_id int, text string")
    queries = spark.createDataFrame([(1, "lpha beta gamma delta epsilon zeta1 en"), (2, "end short"), (3, "alpha  beta gamma delta epsilon zeta1"), (4, "nothing like this is in any text"), (5, None)], "query_id int, query string")
    got = {tuple(r) for r in evaluate.passage_truth(queries, docs).collect()}
    assert got == {(q.query_id, d.document_id) for q in queries.collect() for d in docs.collect() if q.query is not None and q.query in d.text}


def test_fragments_of_urls(spark):
    none = F.lit(None).cast("array<string>")
    cases = spark.createDataFrame([(1, ["EN/1"]), (2, ["/x", "/en/12"]), (3, ["zzz"])], "case_id int, expected_url_substrings array<string>").select("case_id", none.alias("expected_chunk_ids"), none.alias("expected_doc_ids"), none.alias("expected_urls"), "expected_url_substrings")
    docs = spark.createDataFrame([(k, f"http://h/en/{k}") for k in (1, 12, 2)] + [(7, "http://h/X")], "document_id int, url string")
    assert {r.case_id: r.relevant for r in evaluate.ground_truth(cases, docs).collect()} == {1: ["1", "12"], 2: ["12", "7"]}


def mirror(folder):
    site = folder / "site.example"
    site.mkdir(parents=True)
    (site / "a.html").write_text(PAGE)
    (site / "b.md").write_text("# Head\n\nsome words\n")
    (site / "c.csv").write_text('k,v\n1,"two\nlines"\n')
    (site / "d.txt").write_text("plain text of it")


def test_build_of_all_formats_with_index_inside(spark, tmp_path, capsys):
    mirror(tmp_path / "in")
    main.main(["build", str(tmp_path / "in"), str(tmp_path / "out")])
    first = json.loads(capsys.readouterr().out)
    snap = snapshot.open_snapshot(spark, first["snapshot"], verify=True)
    chunks = {r.url.rsplit("/", 1)[1]: r for r in snap.table("chunks").orderBy("ordinal").collect()}
    assert set(chunks) == {"a.html", "b.md", "c.csv", "d.txt"} and chunks["c.csv"].heading_path == ["c"] and "| 1 | two lines |" in chunks["c.csv"].text
    assert "06 12 34 56 78" in chunks["a.html"].text
    ix = index.load_index(spark, f"{snap.path}/index")
    assert ix.lengths.count() == snap.table("chunks").count() and any(n.startswith("index/postings/") for n in snap.manifest["files"])
    # A rebuild keeps the ids, though another file now comes first with the same text.
    ids = {r.canonical_uri: r.document_id for r in snap.table("document_aliases").collect()}
    (tmp_path / "in" / "site.example" / "0.txt").write_text("plain text of it")
    (tmp_path / "in" / "site.example" / "b.md").write_text("# Head\n\nother words\n")
    main.main(["build", str(tmp_path / "in"), str(tmp_path / "out2"), "--former", first["snapshot"]])
    again = snapshot.open_snapshot(spark, json.loads(capsys.readouterr().out)["snapshot"])
    now = {r.canonical_uri: r.document_id for r in again.table("document_aliases").collect()}
    assert {u: now[u] for u in ids} == ids and now["https://site.example/0.txt"] == ids["https://site.example/d.txt"]
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "other words", "expected_urls": ["https://site.example/b.md"]}) + "\n")
    main.main(["evaluate", again.path, str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "metrics")])
    assert '"stage":"final"' in capsys.readouterr().out and spark.read.json(str(tmp_path / "metrics")).count() >= 1


def test_changed_files_are_refused(spark, tmp_path):
    snap = snapshot.commit(spark, str(tmp_path), {"corpora": spark.createDataFrame([("c",)], "corpus_id string").coalesce(1)})
    path = next(os.path.join(d, f) for d, _, fs in os.walk(snap.path.removeprefix("file:")) for f in fs if f.endswith(".parquet"))
    data = bytearray(open(path, "rb").read())
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    data[10] ^= 1
    open(path, "wb").write(data)
    snapshot.open_snapshot(spark, snap.path)
    with pytest.raises(ValueError, match="contents"):
        snapshot.open_snapshot(spark, snap.path, verify=True)
    open(path, "wb").write(data + b"x")
    with pytest.raises(ValueError, match="files"):
        snapshot.open_snapshot(spark, snap.path)


def test_dense_index_runs(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}", f"d{k}") for k in range(5)], "chunk_id string, text string, document_id string")
    embed = lambda x: X.hash_embedding(x, 8)
    run = index.dense_index(chunks, embed, str(tmp_path / "v"), model="hash", dims=8)
    assert run["status"] == "succeeded" and run["vectors"] == 5
    assert index.open_vectors(spark, str(tmp_path / "v"), model="hash", dims=8).count() == 5
    with pytest.raises(ValueError, match="another embedder"):
        index.open_vectors(spark, str(tmp_path / "v"), model="other", dims=8)
    with pytest.raises(ValueError, match="not empty"):
        index.dense_index(chunks, embed, str(tmp_path / "v"), model="hash", dims=8)
    with pytest.raises(ValueError):
        index.dense_index(chunks, lambda x: F.when(x != "text 1", embed(x)), str(tmp_path / "w"), model="hash")
    assert json.load(open(tmp_path / "w" / "run.json"))["status"] == "failed"


def retriever(spark, **more):
    chunks = spark.createDataFrame([(f"c{k}", f"d{k}", f"word{k} common text", "T") for k in range(6)], "chunk_id string, document_id string, text string, title string")
    return engine.Retriever(chunks, index.text_index(chunks, {"content": "text", "title": "title"}), profiles.Profile("p"), **more), chunks


def test_guards_of_the_engine(spark):
    q = spark.createDataFrame([(1, "common")], "query_id int, query string")
    run, chunks = retriever(spark, processor=lambda f: f.withColumn("chunk_id", F.lit("foreign")))
    with pytest.raises(Exception, match="was not given"):
        run.retrieve(q).collect()
    run, _ = retriever(spark)
    assert run.retrieve(q).count() == 6
    for bad in (" ", "x" * 16_001):
        with pytest.raises(Exception, match="1 to 16000"):
            run.retrieve(spark.createDataFrame([(1, bad)], "query_id int, query string")).collect()
    with pytest.raises(TimeoutError):
        run.stages(q, seconds=-1)
    for plan in ([("gone", 5, 1.0)], [("sparse", 0, 1.0)], [("sparse", 5, 101.0)], [("sparse", 5, 1.0)] * 17):
        run.planner = lambda lanes, plan=plan: plan
        with pytest.raises(ValueError):
            run.stages(q)
    with pytest.raises(ValueError, match="another embedder"):
        retriever(spark, vectors=chunks, embedder="a", vector_embedder="b")


def test_strategies(spark):
    q = spark.createDataFrame([(1, "common")], "query_id int, query string")
    run, chunks = retriever(spark, authorized={"title": "T"})
    final = spark.createDataFrame([(1, "c1", 1.0, 1)], "query_id int, chunk_id string, score double, rank int")
    rows, stages, numbers = run.run_strategy(lambda queries: (final, {"own": final}, {"n": 1.0}), q)
    assert rows.first().text == "word1 common text" and set(stages) == {"own"} and numbers == {"n": 1.0}
    for bad in ({"n": float("nan")}, {"n": True}, {str(k): 1.0 for k in range(33)}):
        with pytest.raises(ValueError):
            run.run_strategy(lambda queries, bad=bad: (final, {}, bad), q)
    with pytest.raises(Exception, match="unknown evidence"):
        run.run_strategy(lambda queries: (final.withColumn("chunk_id", F.lit("zz")), {}, {}), q)[0].collect()
    assert {"strategy", "planner", "prompt"} <= registry.CAPABILITIES


def test_prompts(tmp_path):
    (tmp_path / "a.md").write_text("---\nprompt_id: answer\nversion: 2\nrequired_variables: [question]\n---\nSay ${question}\n")
    (tmp_path / "b.md").write_text("plain")
    found = prompts.Prompts.of(str(tmp_path))
    assert found["answer"].render(question="x") == "Say x" and [p["prompt_id"] for p in found.inventory()] == ["answer", "b"]
    assert found.trace("answer", "b")["combined_sha256"] == hashlib.sha256((found["answer"].sha256 + "\n" + found["b"].sha256).encode()).hexdigest()
    with pytest.raises(ValueError):
        found["answer"].render()
    with pytest.raises(KeyError):
        found["none"]
    (tmp_path / "c.md").write_text("---\nprompt_id: answer\n---\nx")
    with pytest.raises(ValueError):
        prompts.Prompts.of(str(tmp_path))


def test_ocr_routing(spark):
    assert one(spark, "  few ", pages.needs_ocr("x")) and not one(spark, "long enough " * 5, pages.needs_ocr("x")) and one(spark, None, pages.needs_ocr("x"))


def test_only_given_candidates(spark):
    given = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, chunk_id string")
    assert retrieve.only_given(given.where("chunk_id = 'b'"), given).count() == 1


def test_entry_imports_without_training_operators(tmp_path):
    """The driver's deletion, on a copy: the entry still gives the engine's queries."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "gleaner"), tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr
