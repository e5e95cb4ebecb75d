import hashlib
import unicodedata

from pyspark.sql import functions as F

from gleaner.functions import text as X, urls as U
from gleaner.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_normalised_content_and_hash(spark):
    raw = "  a \r\nb\t\r\r\r\rc \n\n\n\nd  "
    want = "a\nb\n\nc\n\nd"
    assert one(spark, raw, X.normalized_content("x")) == want
    assert one(spark, raw, X.content_hash("x")) == hashlib.sha256(want.encode()).hexdigest()


def test_stable_id(spark):
    want = "gl_source_object_" + hashlib.sha256("a\x1f1".encode()).hexdigest()[:24]
    assert one(spark, "a", X.stable_id("source-object", "x", F.lit(1))) == want


def test_unicode_functions(spark):
    assert one(spark, "é", X.nfc("x")) == "é"
    assert one(spark, "Ǻß", X.folded_any("x")) == "aß"
    assert one(spark, "Éà Straße", X.folded("x")) == "ea straße"
    assert one(spark, "Straße STRASSE", X.word_set("x")) == ["strasse"]
    assert one(spark, "snake_case x1", X.terms("x")) == ["snake", "case", "x1"]
    assert one(spark, None, X.nfc("x")) is None and unicodedata.is_normalized("NFC", one(spark, "ño", X.nfc("x")))


def test_text_clean_up(spark):
    assert one(spark, "a\x00\x07b  c\t\td\n\n\n\ne ", X.normalized_text("x")) == "ab c d\n\ne"
    assert one(spark, "mail jo.e (at) ex [dot] co dot uk or x chez y point fr", X.deobfuscated_email("x")) == "mail jo.e@ex.co.uk or x@y.fr"
    assert one(spark, "call 06.12.34.56.78 or 12345", X.phone_pairs("x")) == "call 06 12 34 56 78or 12345" or "06 12 34 56 78" in one(spark, "call 06.12.34.56.78 or 12345", X.phone_pairs("x"))
    assert one(spark, " a  b c ", X.token_count("x")) == 3


def test_embedding_text(spark):
    assert one(spark, "t", X.embedding_text(F.lit(" Title "), F.lit("A > B"), "x")) == "Title\nA > B\nt"
    assert one(spark, "t", X.embedding_text("x", "x", "x")) == "t"
    for value in ("details", "passage: details", "query: details"):
        assert one(spark, value, X.with_role("x", "query")) == "query: details"


def test_cosine_and_norms(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0, 1.0])], "a array<double>, z array<double>, b array<double>")
    assert row.select(X.cosine("a", "z")).first()[0] == 0.0
    assert row.select(X.l2_normalized("a")).first()[0] == [0.6, 0.8] and row.select(X.l2_normalized("z")).first()[0] == [0.0, 0.0]
    e = one(spark, "x", X.hash_embedding("x", 384))
    assert len(e) == 384 and abs(sum(v * v for v in e) - 1) < 1e-9


def test_token_f1(spark):
    assert one(spark, "a b c", X.token_f1("x", F.lit("b c d"))) == 2 / 3
    assert one(spark, "a", X.token_f1("x", F.lit("b"))) == 0.0 and one(spark, "", X.token_f1("x", F.lit("b"))) is None


def test_url_rewrites(spark):
    rules = [U.Rewrite(host="old.example", to_host="new.example"), U.Rewrite(path="/a", to_path="/b"), U.Rewrite(prefix="/docs/", to_path="/d/")]
    for url, want in (
        ("https://Old.example:8080/x?q#f", "https://new.example:8080/x?q#f"),
        ("https://u@h.example/a?x=1", "https://u@h.example/b?x=1"),
        ("https://H.example/docs/p/q", "https://h.example/d/p/q"),
        ("https://H.example/other", "https://H.example/other"),
        ("https://h.example/a/b", "https://h.example/a/b"),
    ):
        assert one(spark, url, U.canonical_url("x", rules)) == want


def test_url_parts(spark):
    assert one(spark, "https://Ex.org:80/a/b?x", U.site_host("x")) == "ex.org:80"
    assert one(spark, "https://ex.org", U.path_prefix("x")) == "/" and one(spark, "https://ex.org//a/b", U.path_prefix("x")) == "/a"
    assert one(spark, "http://a/x?y#z", U.has_query("x")) == 1 and one(spark, "http://a/x#z?y", U.has_query("x")) == 0
    assert one(spark, "see http://a.b/c and http://a.b/d.", U.rewritten_in_text("x", [("http://a.b", "https://z")])) == "see https://z/c and https://z/d."


def test_file_types(spark):
    for path, mime, want in (("a/B.HTM", None, "html"), ("x.mdx", None, "markdown"), ("x", "Text/Html; charset=x", "html"), ("x.bin", "image/foo", "image"), ("x", "text/foo", "text"), ("x", None, "unknown")):
        assert one(spark, path, files.content_type("x", F.lit(mime))) == want
    assert one(spark, "word", files.source_family("x")) == "document" and one(spark, "foo", files.source_family("x")) == "unknown"


def test_mirror(spark, tmp_path):
    (tmp_path / "site.example" / "sub").mkdir(parents=True)
    (tmp_path / "site.example" / "index.html").write_text("<p>x</p>")
    (tmp_path / "site.example" / "sub" / "n.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "skip.bin").write_text("x")
    found = files.scan_mirror(spark, str(tmp_path)).cache()
    rows = {r.relative_path: r for r in found.select("relative_path", files.decoded("content").alias("t"), files.mirror_url("relative_path", F.lit(""), "https://b").alias("u")).collect()}
    assert set(rows) == {"site.example/index.html", "site.example/sub/n.txt"}
    assert rows["site.example/sub/n.txt"].t == "é" and rows["site.example/index.html"].u == "https://site.example/"
    digest = hashlib.sha256()
    for name in sorted(rows):
        digest.update(name.encode() + b"\0" + hashlib.sha256((tmp_path / name).read_bytes()).digest() + b"\0")
    assert files.snapshot_digest(found) == digest.hexdigest()
    good = [(n, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), f"u:{n}") for n in rows]
    bind = lambda b: {tuple(r) for r in files.check_bindings(found, spark.createDataFrame(b, "relative_path string, content_sha256 string, source_uri string")).collect()}
    assert bind(good) == set()
    assert bind([(good[0][0], "0", "u"), ("gone", "1", "v")]) == {(good[0][0], "content differs"), (good[1][0], "not bound"), ("gone", "missing file")}


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"case_id": "1"}\n\n{"case_id": "2"}\n')
    (tmp_path / "b.json").write_text('{"cases": [{"case_id": "3"}]}')
    (tmp_path / "c.json").write_text('[{"case_id": "4"},\n {"case_id": "5"}]')
    got = [sorted(r.case_id for r in files.read_eval_rows(spark, str(tmp_path / f), "case_id string").collect()) for f in ("a.jsonl", "b.json", "c.json")]
    assert got == [["1", "2"], ["3"], ["4", "5"]]
