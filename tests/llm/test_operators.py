"""Every operator against a plain version, on a small table with every awkward row."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bm25, decontam, htmlmain, jaccard, langid, linedup, packing, quality, spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, site int, fp string"
rng = np.random.default_rng(3)
WORDS = ["the", "of", "river", "stone", "cloud", "garden", "window", "silver", "market", "engine", "paper", "north", "winter", "letter", "harbor", "signal", "copper", "meadow", "valley", "lantern"]


def prose(n):
    out = []
    for k in range(n):
        w = str(rng.choice(WORDS)) + (str(rng.choice(["", "ing", "ed", "er"])))
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base = [(k, prose(30 + 7 * k), "en" if k % 2 else "de", f"src{k % 12}") for k in range(40)]
    base += [(100 + k, base[0][1], "en", f"src{k}") for k in range(15)]  # exact copies
    words = base[20][1].split()
    base += [(200 + k, " ".join([*words[: 20 + k], "changed", *words[21 + k :]]), "en", "src1") for k in range(14)]  # near copies
    base += [(300 + k, f"{prose(25)}\nShared line of all sites.\n{prose(20)}", "en", f"src{k}") for k in range(12)]
    base += [(400, None, None, None), (401, "", "en", ""), (402, " \n\t ", None, "src1"), (403, "12 34 !!", "de", None), (404, "one two", "en", "src2"), (405, "ONE  two", "en", "src2"), (406, "a", "en", "src3")]
    base += [(407, prose(30_000), "en", "src4"), (407, "same id, other text with a few words in it", "en", "src4"), (None, prose(40), "en", "src5"), (8, base[8][1], "en", "src8"), (409, "naïve Ünïcode’s “quotes” don't 你好 ① \x1c <|endoftext|> it's", "en", "src1")]
    return [(*r, len(r[1] or ""), "k", 7, 3, "z") for r in base]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, F.xxhash64("doc_id", "text")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1 if r[0] % 3 else 0, int("changed" in (r[1] or ""))) for r in rows if r[0] is not None] + [(999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs, lane_tokens=4000).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r[0], len(ids)] += 1
    got = Counter()
    by_doc: dict = {}
    for p in out:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (d, n), ps in by_doc.items():
        got[d, n] = sum(p.length for p in ps) / n
        texts = [np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows if r[0] == d]
        for p in ps:
            assert any(zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for t in texts)
    assert got == want
    seqs: dict = {}
    for p in out:
        seqs.setdefault(p.sequence_id, []).append(p)
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at & (at - 1) == 0 and at <= 1024


def test_packing_windows_hold_proportions():
    queues = np.repeat(np.arange(4), 200)
    lens = np.full(800, 500)
    shares = np.full(4, 0.25)
    windows = list(packing.fill(queues, lens, shares, np.zeros(4)))
    for w in windows[:-3]:
        by = Counter()
        for d, _, n in w:
            by[int(queues[d])] += n
        assert sum(by.values()) == 1024 and max(by.values()) <= 256 + 40


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_line_dedup(docs, rows, none):
    out = linedup.dedup_lines(docs)
    assert out.columns == [*SCHEMA_NAMES, "n_lines", "n_removed"]
    spread: dict = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" \t\r"):
                spread.setdefault(line.strip(" \t\r"), set()).add(r[3] or "")
    heavy = {k for k, v in spread.items() if len(v) >= linedup.MIN_SITES}
    assert "Shared line of all sites." in heavy
    kept = Counter()
    for r in out.collect():
        lines = r.text.split("\n") if r.text is not None else []
        for line in lines:
            if line.strip(" \t\r") in heavy:
                kept[line.strip(" \t\r")] += 1
        original = [x[1] for x in rows if x[0] == r.doc_id]
        if r.n_removed == 0:
            assert r.text in original
    assert all(kept[k] == 1 for k in heavy)
    assert linedup.dedup_lines(none).count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def brute_components(rows):
    sets, ids = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
        ids.append(r[0])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    out = Counter()
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[ids[i], len(sets[i]), min(known) if known else None] += 1
    return out


@pytest.mark.parametrize("crowd,fineness", [(jaccard.CROWD, jaccard.FINENESS), (2, (0.25, 0.3))])
def test_jaccard_components(docs, rows, crowd, fineness, monkeypatch):
    monkeypatch.setattr(jaccard, "FINENESS", fineness)
    got = Counter(tuple(r) for r in jaccard.similarity_components(docs, crowd).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_jaccard_sketch_bounds_the_difference():
    for n in (1, 4, 5, 12, 60, 300):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = max(0, len(a) // 9)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            band = set(jaccard.bands(len(a))) & set(jaccard.bands(len(b)))
            assert any(set(jaccard.sketch(a, k, 0.32)[0].tolist()) & set(jaccard.sketch(b, k, 0.32)[0].tolist()) for k in band)


def test_jaccard_empty_and_keep_one(docs, rows, none):
    assert jaccard.similarity_components(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == SCHEMA_NAMES
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 0 in ids and not {100, 105} & set(ids) and {400, 401, 402} <= set(ids) and None in ids
    assert len({20, *range(200, 214)} & set(ids)) == 1


def test_span_dedup_against_plain(docs, rows, none):
    out = {(r.doc_id, r.n_sentences): r for r in spans.dedup_spans(docs).collect()}
    seen, n_removed = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        data = np.frombuffer((rows[i][1] or "").encode(), np.uint8)
        starts, ends, begins, rws = spans.sentences(data, np.array([0, len(data)]))
        to = spans.span_ends(begins, rws, len(starts))
        edge = [*begins.tolist(), len(starts)]
        words = [bytes(spans.LOWER[data[a:b]]) for a, b in zip(starts, ends)]
        gone = set()
        for k in range(len(begins)):
            if to[k] >= 0:
                key = b" ".join(words[edge[k] : edge[to[k]]])
                first = seen.setdefault(key, (rows[i][0], rows[i][1], k))
                if first != (rows[i][0], rows[i][1], k):
                    gone |= set(range(k, to[k]))
        n_removed.setdefault((rows[i][0], len(begins)), set()).add(len(gone))
    for key, r in out.items():
        assert r.n_removed in n_removed[key], key
    assert sum(1 for k in range(1, 15) if out[100 + k, out_n(rows, 100 + k)].text == "") == 14
    assert spans.dedup_spans(none).count() == 0


def out_n(rows, doc_id):
    text = next(r[1] for r in rows if r[0] == doc_id)
    data = np.frombuffer(text.encode(), np.uint8)
    return len(spans.sentences(data, np.array([0, len(data)]))[2])


def test_span_dedup_finds_a_pasted_passage(spark):
    passage = "It begins here with some words of its own. Then a second one follows at length. " * 1 + prose(50)
    rows = [(k, prose(40).rstrip(".") + " " + passage + " " + prose(40), "s") for k in range(3)]
    out = sorted(spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert "Then a second one follows" in out[0].text
    assert all("Then a second one follows" not in r.text for r in out[1:])
    assert out[0].n_removed == 0


@pytest.mark.parametrize("size", [50, 61, 200])
def test_span_dedup_does_not_depend_on_the_words_before(spark, size):
    """Lower-case passages without stops, pasted at every word offset, go but for their ends."""
    own = np.random.default_rng(size)
    word = lambda n: ["w" + "".join(own.choice(list("abcdefghij"), 7)) for _ in range(n)]
    passage = word(size)
    rows = [(k, " ".join(word(20 + k) + passage + word(30))) for k in range(23)]
    out = sorted(spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    for r, (k, text) in zip(out[1:], rows[1:]):
        left = set(r.text.split())
        assert len(left & set(passage)) <= 2 * spans.MAX_WORDS + spans.MIN_WORDS
        assert left >= set(text.split()) - set(passage)


def test_content_cuts_leave_no_long_sentence():
    data = np.frombuffer(" ".join(str(x) for x in rng.integers(0, 50, 5000)).encode(), np.uint8)
    starts, _, begins, _ = spans.sentences(data, np.array([0, len(data)]))
    assert np.diff(np.append(begins, len(starts))).max() <= spans.MAX_WORDS


def test_bm25_matches_full_scoring(docs, rows, none, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    table = [(r[0], r[1] or "") for r in rows]
    words = [Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[^\s a-z0-9\x80-\U0010ffff]", "", plain(t)))) for _, t in table]
    length = np.array([sum(c.values()) for c in words])
    mean = length.mean()
    df = Counter(w for c in words for w in c)
    got: dict = {}
    queries = docs.where("doc_id < 12 and doc_id is not null").select(F.col("doc_id").alias("query_id"), "text").distinct()
    for r in bm25.search(docs, queries, 5, query_terms=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    for q in range(12):
        score = np.zeros(len(words))
        for w, n in words[q].items():
            idf = np.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in enumerate(words):
                if w in c:
                    score[i] += n * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        best = np.sort(score)[::-1][:5]
        assert np.allclose([s for _, s in sorted(got[q])], best, atol=2e-6)
    assert bm25.search(none, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
    assert bm25.search(docs, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def plain(text):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" else c for c in text).replace("×", "×")


def test_decontamination(spark, docs, none):
    item = prose(36)
    noisy = " ".join(w for k, w in enumerate(item.split()) if k % 7)
    rows = [(1, prose(60) + "\n" + item + " " + prose(50)), (2, prose(30) + " " + item.upper()), (3, prose(40) + " " + noisy + " " + prose(30)), (4, prose(300)), (5, None), (6, ""), (7, "short"), (None, item)]
    some = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, leaked string")
    bench = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "!!", 1), (14, prose(30), 1)], "item_id long, text string, extra int")
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(some, bench).collect()}
    assert {(1, 10), (2, 10), (3, 10), (None, 10)} == {k for k in found if k[1] == 10}
    assert found[1, 10].lcs == 1.0 and 0.7 <= found[3, 10].lcs < 1
    kept = decontam.decontaminate(some, bench)
    assert kept.columns == ["doc_id", "text", "leaked"] and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_where_later_words_are_nearer(spark):
    """An exact item is found although what follows repeats its words in other orders and is nearer to it."""
    own = np.random.default_rng(8)
    item = [f"item{k}" for k in range(36)]
    noise = lambda n: [f"noise{k}" for k in own.integers(0, 400, n)]
    rows = [(k, " ".join(noise(40 + k) + item + [w for _ in range(4) for w in own.permutation(item)] + noise(30))) for k in range(32)]
    rows += [(100 + k, " ".join(noise(150))) for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(noise(30)))], "item_id long, text string")
    found = {r.doc_id: r.lcs for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("item_id = 1").collect()}
    assert found == {k: 1.0 for k in range(32)}


def test_common_length():
    a, b = np.array([1, 2, 3, 4, 5, 6]), np.array([9, 2, 4, 9, 3, 5, 6, 1])
    assert decontam.common_length(a, b) == 4
    assert decontam.common_length(a, b[:0]) == 0


def test_language_id(spark, none):
    en, fr = "the and that with this have from they would there".split(), "les des une dans pour avec sont mais nous leur".split()
    text = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(k, text(en if k % 2 else fr, 40), "en" if k % 2 else "fr") for k in range(400)] + [(500, None, "en"), (501, "", None), (502, "123 !", "fr"), (None, text(en, 30), "en"), (503, text(fr, 60_00), "fr")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lettered int")
    out = {r.doc_id: r for r in langid.identify(table, 100).collect()}
    held = [r for k, r in out.items() if k is not None and k < 400 and r.held_out]
    assert sum(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in held) >= 0.97 * len(held) > 90
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (500, 501, 502)) and not out[None].held_out
    assert out[503].lang_pred == "fr" and all(0 <= r.score <= 1 for r in out.values())
    empty = none.select("doc_id", "text", "lang")
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(table.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_net_gradient():
    """Backpropagation agrees with what training must do: the loss of a separable toy falls to near nothing."""
    seg = np.array([[97, 98] * 8, [99, 100] * 8] * 32, np.uint8)
    net = langid.fit(seg, np.array([0, 1] * 32), ["x", "y"], epochs=30, batch=16)
    data = np.frombuffer(b"ab" * 64 + b"cd" * 64, np.uint8)
    p = net.pooled(data, np.array([0, 128, 256]))
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9


def test_toxicity_and_quality(spark, docs, labels, none):
    insults = ["blockhead", "dimwit", "numskull"]
    rows, marks = [], []
    for k in range(600):
        words = prose(60).split()
        bad, junk = k % 7 == 0, k % 6 == 0
        if bad:
            for j in (5, 20, 33):
                words[j] = str(rng.choice(insults))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "x"))
        marks.append((k, int(not junk), int(bad)))
    rows += [(700, None, "x"), (701, "", "x"), (None, "blockhead you dimwit", "x")]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(table, marks).collect()
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in held) >= 0.95 * len(held) and len(out) == len(rows)
    good = quality.quality(table, marks).collect()
    held = [r for r in good if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 6 != 0) for r in held) >= 0.95 * len(held) and len(good) == len(rows)
    assert all(0 <= r.score <= 1 for r in out + good)
    kept = toxicity.keep_clean(table, marks)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in out if r.predicted == 0} == {r.doc_id for r in kept.collect()}
    bare = labels.limit(0)
    assert toxicity.toxicity(docs, bare).count() == docs.count() == quality.quality(docs, bare).count()
    assert toxicity.toxicity(none, marks).count() == 0 == quality.quality(none, marks).count()
    assert toxicity.toxicity(docs, labels).count() == docs.count() == quality.quality(docs, labels).count()


PAGE = "<html><head><title>t</title><script>x('</p>')</script></head><body><nav><a href=/>menu</a></nav><div class='box{n}'><h1>Head &amp; more</h1><p>First <b>bold<br>text\n here<p>Second part of it<ul><li>one<li>two</ul><div class=comments><p>reader says</div></div><aside>side</aside><footer>foot</footer></body>"


def test_html_main_text(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.replace("{n}", str(k)), 1) for k in range(8)] + [(20, None, "<p>a < b</p> tail", 1), (21, "http://h0.example/x", None, 1), (22, "http://h0.example/y", "", 1), (None, "http://h1.example/z", "<div><p>never closed", 1), (24, "http://h2.example/", "<nav>only menu</nav>", 1)]
    out = {r.page_id: r for r in htmlmain.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, paths int")).collect()}
    assert all(out[k].text == "Head & more\nFirst bold text here\nSecond part of it\none\ntwo" for k in range(8))
    assert out[20].text == "a < b\ntail" and out[21].text == out[22].text == out[24].text == "" and out[None].text == "never closed"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert htmlmain.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host_path_wins_over_a_page_of_its_own():
    """A page whose longest block is elsewhere follows its host."""
    page = "<body><div class=story><p>short</p></div><div class=other><p>" + "long " * 400 + "</p></div></body>"
    assert htmlmain.main_text(page, ["body>div.story"]) == "short"
    assert htmlmain.main_text(page, ["body>div.missing"]).startswith("long long")


def test_html_title_and_lead_stay_on_long_pages(spark):
    """Depth settles only exact ties of text share."""
    page = lambda k, n: f"<body><nav>menu</nav><article><h1>Head {k}</h1><p class=lead>Lead of it</p><div class=content><p>{'long text ' * n}</p></div></article></body>"
    rows = [(k, f"http://h.example/{k}", page(k, 5000 if k else 30)) for k in range(6)]
    out = {r.page_id: r.text for r in htmlmain.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k].startswith(f"Head {k}\nLead of it\nlong text") for k in range(6))
    assert htmlmain.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first().paths[0] == "body>article"


def test_page_of_a_mixed_host_takes_the_path_with_most_of_its_text():
    page = "<body><div class=story><p>short</p></div><div class=other><p>" + "long " * 400 + "</p></div></body>"
    assert htmlmain.main_text(page, ["body>div.story", "body>div.other"]).startswith("long long")
    assert htmlmain.main_text(page, ["body>div.story", "body"]).startswith("short\nlong")
