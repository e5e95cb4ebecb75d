"""What the methods promise beyond their results: gradients, pruning, mixtures, awkward rows, malformed pages."""

import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bm25, decontam, htmlmain, jaccard, langid, linedup, packing, quality, spans, style
from gleaner.llm.common import hash_spans

rng = np.random.default_rng(5)
WORDS = [a + b for a in ("ri", "sto", "clou", "gar", "win", "sil", "mar", "en", "pa", "nor") for b in ("ver", "ne", "den", "dow", "ket", "gine", "per", "th")]


def prose(n, size=9):
    w = [str(rng.choice(WORDS)) for _ in range(n)]
    return " ".join(x + ("." if k % size == size - 1 else "") for k, x in enumerate(w))


def test_language_net_gradient_by_finite_differences():
    p = {k: v.astype(float) for k, v in langid.start(3, np.random.default_rng(1), 4).items()}
    x, y = np.random.default_rng(2).integers(97, 123, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = langid.gradients(p, x, y)
    off = 0
    for name, values in p.items():
        flat, slope = values.reshape(-1), g[name].reshape(-1)
        live = np.flatnonzero(slope) if name == "table" else np.arange(len(flat))
        for k in np.random.default_rng(3).choice(live, min(25, len(live)), replace=False):
            at = flat[k]
            sides = []
            for step in (1e-5, -1e-5):
                flat[k] = at + step
                sides.append(langid.gradients(p, x, y)[0])
            flat[k] = at
            off += abs((sides[0] - sides[1]) / 2e-5 - slope[k]) > 1e-4 * max(1, abs(slope[k]))
    assert off <= 2  # a clipped gate may lie on its corner


def test_language_sample_is_bounded_where_rows_repeat(spark):
    rows = [(6, "en", "the same text of one row again and again")] * 3000 + [(k, "de", prose(20)) for k in range(40)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), per_lang=5)
    assert net is None or set(net.langs) <= {"en", "de"}


def brute_scores(texts, queries, k):
    split = [[w.strip(".") for w in t.split()] for t in texts]
    n, mean = len(texts), sum(map(len, split)) / len(texts)
    df = {}
    for s in split:
        for w in set(s):
            df[w] = df.get(w, 0) + 1
    out = []
    for q in queries:
        found = []
        for d, s in enumerate(split):
            score = sum(np.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) * (f := s.count(w)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in (x.strip(".") for x in q.split()) if w in s)
            if score:
                found.append((-round(score, 6), d))
        out.append([d for _, d in sorted(found)[:k]])
    return out


def test_wand_passes_over_posting_blocks_and_is_exact(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    texts = [prose(int(rng.integers(5, 60))) for _ in range(300)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    rows = [r for b in bm25.shards_of(iter([batch])) for r in b.to_pylist()]
    queries = [" ".join(rng.choice(WORDS, 4)) for _ in range(25)] + texts[:10]
    vectors = next(bm25.vectors_of(iter([pa.RecordBatch.from_pydict({"query_id": list(range(len(queries))), "text": queries})]))).to_pylist()
    terms = [np.frombuffer(v["terms"], np.uint64) for v in vectors]
    vocab = np.unique(np.concatenate(terms))
    lens = np.concatenate([np.frombuffer(r["lens"], np.int32) for r in rows])
    df = np.zeros(len(vocab))
    for r in rows:
        t, c = np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32)
        pos = np.minimum(np.searchsorted(t, vocab), len(t) - 1)
        df += np.where(t[pos] == vocab, c[pos], 0)
    idf = np.log(1 + (len(lens) - df + 0.5) / (df + 0.5))
    shard = bm25.Shard(rows[0], vocab, lens.mean())
    assert len(rows) == 1
    for want, t, v in zip(brute_scores(texts, queries, 5), terms, vectors):
        numbers = np.searchsorted(vocab, t)
        pick, score = shard.top(numbers, idf[numbers] * np.frombuffer(v["counts"], np.int32), 5, 0.0)
        got = sorted((-round(float(s), 6), shard.ids[i]) for i, s in zip(pick, score))[:5]
        assert [d for _, d in got] == want
    assert 0 < shard.read < shard.met


def windows_of(queues, lens, share, owed):
    out = []
    for w in packing.fill(queues, lens, np.array(share, float), np.array(owed, float)):
        by = np.zeros(len(share))
        for d, _, n in w:
            by[queues[d]] += n
        out.append(by / by.sum())
    return np.array(out)


def test_windows_follow_a_given_mixture_though_rows_are_ordered():
    queues, lens = np.repeat([0, 1, 2], [600, 300, 300]), rng.integers(20, 900, 1200)
    for share in ([0.5, 0.25, 0.25], [0.2, 0.3, 0.5], [0.1, 0.45, 0.45]):
        got = windows_of(queues, lens, share, [0, 0, 0])
        assert np.abs(got[:100] - share).max() < 0.06


def test_a_lane_pays_what_earlier_lanes_owe():
    queues, lens = np.arange(900) % 3, np.full(900, 700)
    share = [1 / 3] * 3
    got = windows_of(queues, lens, share, [4000.0, -4000.0, 0.0])
    first = got[:40].mean(0)
    assert first[0] > 0.36 > 0.31 > first[1]
    served = (got[:120] * 1024).sum(0)
    assert abs(served[0] - served[1] - 8000) < 1500


def test_many_sources_take_no_long_time():
    queues, lens = rng.integers(0, 100_000, 150_000), rng.integers(1, 9, 150_000)
    began = time.time()
    total = np.bincount(queues, lens, 100_000)
    assert sum(n for w in packing.fill(queues, lens, total / total.sum(), np.zeros(100_000)) for _, _, n in w) == lens.sum()
    assert time.time() - began < 30


def test_pack_takes_targets(spark):
    rows = [(k, prose(120), "a" if k < 200 else "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "name string, share double")
    out = packing.pack(docs, lane_tokens=1 << 16, targets=targets)
    # The first windows of a task's first lane, to which nothing is owed.
    first = out.where((F.col("sequence_id") < 1 << 44) & (F.col("sequence_id") % (1 << 44) < 10)).groupBy("sequence_id").agg(F.sum(F.when(F.col("source") == "b", F.col("length")).otherwise(0)).alias("b"), F.sum("length").alias("all"))
    shares = [r.b / r["all"] for r in first.where("all = 1024").collect()]
    assert shares and max(abs(s - 0.5) for s in shares) < 0.1


def test_paraphrases_of_items_are_found(spark):
    items = [" ".join(str(x) for x in rng.choice(WORDS, 40)) + f" item{k} answer{k}" for k in range(30)]
    rows, want = [], set()
    for k, item in enumerate(items):
        words = item.split()
        kept = [w if j % 6 else "other" + w for j, w in enumerate(words)]
        want.add((k, k))
        rows.append((k, prose(70) + " " + " ".join(kept) + " " + prose(50)))
    rows += [(100 + k, prose(200)) for k in range(30)]
    long = " ".join(str(x) for x in rng.choice(WORDS, 400))
    rows.append((500, prose(100) + " " + long + " " + prose(60)))
    bench = spark.createDataFrame([*enumerate(items), (900, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert (500, 900) in got and len(want & got) >= 0.9 * len(want)
    assert not {d for d, _ in got} & set(range(100, 130))


CLASH = "doc_id long, text string, source string, row long, _row long, fp long, key string, gone int, label long, n_lines int, n_removed int, lang_pred string, score double, copy int, held_out int, leaked int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4, 5, 6, 7, "x", 0.5, 8, 9, 10) for r in rows], CLASH)


def test_stages_judge_rows_of_one_id_each_by_itself(spark, tmp_path):
    same, other, item = prose(60), prose(50), prose(40)
    docs = clashing(spark, [(3, same, "s"), (7, same, "s"), (7, other, "s"), (1, prose(30) + " " + item + " " + prose(20), "s"), (1, prose(45), "s"), (None, same, "s"), (5, None, None), (5, "", "s")])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect() if (r.doc_id, r.text) != (7, same))
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 7 and clean.where("doc_id = 1").count() == 1
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.columns == docs.columns and lines.count() == 8
    assert {"n_lines_", "n_removed_"} <= set(linedup.dedup_lines(docs).columns)


@pytest.mark.parametrize("crowd", [2, 4])
def test_crowded_groups_lose_no_link(spark, crowd):
    """Many near copies of one text, each also a near copy of another: all links, at a low bound of crowds."""
    base = prose(150).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, prose(150)) for k in range(10)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), crowd).collect()}
    assert got == {d: root(d) for d in sets}


def test_components_by_propagation_equal_those_of_one_task(spark, monkeypatch):
    pairs = [(int(a), int(b)) for a, b in np.sort(rng.integers(0, 400, (250, 2)), axis=1) if a != b] + [(1000 + k, 1001 + k) for k in range(30)]
    links = spark.createDataFrame(pairs, "a long, b long")
    one = {tuple(r) for r in jaccard.components(links).collect()}
    monkeypatch.setattr(jaccard, "ONE_TASK", 0)
    assert {tuple(r) for r in jaccard.components(links).collect()} == one


def test_span_dedup_texts_against_words(spark):
    """A plain version over words, written apart: what an earlier document has in runs of 60 words or more goes but for its ends, the rest stays."""
    passages = [" ".join(str(x) for x in rng.choice(WORDS, 60)) for _ in range(4)]
    rows = []
    for k in range(24):
        own = prose(40), prose(int(rng.integers(30, 60)))
        rows.append((k, f"{own[0]} {passages[k % 4]} {own[1]}" if k % 3 else prose(120)))
    out = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for k, text in rows:
        p = passages[k % 4] if k % 3 else None
        if p is None or p not in seen:
            assert out[k].text == text and out[k].n_removed == 0
            if p:
                seen.add(p)
            continue
        before, after = text.split(p)
        left = out[k].text.split()
        assert out[k].n_removed > 0
        assert left[: len(before.split())] == before.split() and left[len(left) - len(after.split()) :] == after.split()
        assert len(left) - len(before.split()) - len(after.split()) <= 2 * spans.MAX_WORDS


def test_repeats_inside_one_document(spark):
    verse = prose(40)
    docs = spark.createDataFrame([(1, f"{verse} {prose(30)} {verse}"), (2, prose(50))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in spans.dedup_spans(docs).collect()} == {1: 0, 2: 0}
    assert spans.dedup_spans(docs, within=True).where("doc_id = 1").first().n_removed > 0


@pytest.mark.parametrize(
    "html",
    ["<p " * 200_000, '<p "' * 100_000 + ">", "<p a='x>text " * 50_000, "<div>" * 100_000 + "deep", "<div class=a1>" * 50_000 + "</p></div>" * 50_000, "<ul>" * 100_000 + "</p>" * 100_000, "<form>" * 50_000 + "x", "<svg>" * 50_000 + "x", "<!--" * 100_000, "<blockquote>" * 100_000, "<header>" * 50_000, "a < b " * 100_000, "<tr><dd><li>" * 30_000],
    ids=lambda h: h[:6],
)
def test_malformed_pages_take_linear_time(html):
    began = time.time()
    htmlmain.scores(*htmlmain.read(html))
    htmlmain.main_text(html, [])
    assert time.time() - began < 20


TEMPLATES = [
    "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>{t}</h1><p>{a}</p><p>{b}</p></article><footer>(c) site</footer></body>",
    "<body><div id=menu><a href=/a>One</a> <a href=/b>Two</a></div><div class='post-body'><h2>{t}</h2><p>{a}<p>{b}</div><div class='comments'><p>a reader writes at length about it and more</p></div></body>",
    "<body><form action=/ method=post><input type=hidden name=v><table><tr><td class=side><a href=/>x</a></td><td class=content><h1>{t}</h1><p>{a}</p><p>{b}</p></td></tr></table></form></body>",
    "<body><header><a href=/>Site</a></header><main><div class=article-legal><h1>{t}</h1><p>{a}</p><div class=search-results-story><p>{b}</p></div></div><aside><p>related things</p></aside></main></body>",
    "<body><div class=cookie-notice><p>we use cookies</p></div><section class='story'><h1>{t}</h1><p>{a}</p><div class=newsletter><p>sign up now</p></div><p>{b}</p></section><script>var x='<p>no</p>';</script></body>",
]


def test_labelled_templates_precision_and_recall(spark):
    """Every template on a host of its own: all lines of the article, nothing else."""
    rows, want = [], {}
    for k in range(60):
        t, a, b = prose(5), prose(40), prose(int(rng.integers(5, 80)))
        rows.append((k, f"http://h{k % 5}.example/{k}", TEMPLATES[k % 5].format(t=t, a=a, b=b)))
        want[k] = {t, a, b}
    good = found = 0
    for r in htmlmain.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        lines = set(r.text.split("\n"))
        good += len(lines & want[r.page_id])
        found += len(lines)
    assert good == found == 180  # precision and recall of 1


def test_hot_hosts_are_split_with_the_same_result(spark, monkeypatch):
    rows = [(k, f"http://{'big' if k % 4 else f'h{k}'}.example/{k}", TEMPLATES[0].format(t=f"T{k}", a=prose(20), b=prose(10))) for k in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, htmlmain.extract_main(pages).collect()))
    monkeypatch.setattr(htmlmain, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(htmlmain, "HOT", 8)
    assert sorted(map(tuple, htmlmain.extract_main(pages).collect())) == want


def test_labels_other_than_0_and_1_are_none(spark):
    docs = spark.createDataFrame([(k, prose(30)) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4) for k in range(30)], "doc_id long, toxic int")
    assert set(style.labelled(docs, labels, "toxic", 5, 9, 100).column("label").to_pylist()) == {0, 1}


def test_the_sample_does_not_follow_the_order_of_rows(spark):
    rows = [(k % 7, prose(12)) for k in range(200)]
    labels = spark.createDataFrame([(k, 1) for k in range(7)], "doc_id long, quality int")
    take = lambda r: style.labelled(spark.createDataFrame(r, "doc_id long, text string").repartition(3), labels, "quality", 4, 9, 5)
    a, b = take(rows), take(rows[::-1])
    assert a.num_rows == 10 and a.equals(b)


def test_prior_counts_all_documents(spark):
    docs = spark.createDataFrame([(k, prose(40) if k % 2 else "zz zz zz !!! $$$ " * 8) for k in range(400)], "doc_id long, text string")
    p, u = ({"doc_id": x} for x in (1, 2))
    import pyarrow as pa

    texts = {r.doc_id: r.text for r in docs.collect()}
    p = pa.table({"doc_id": [k for k in range(1, 400, 2)], "text": [texts[k] for k in range(1, 400, 2)]})
    u = pa.table({"doc_id": list(range(100)), "text": [texts[k] for k in range(100)]})
    prior = quality.estimate_prior(docs, p, u, quality.table_style(p), quality.table_style(u), 4, 9)
    assert 0.4 < prior < 0.65


def test_hashes_of_spans_do_not_depend_on_place():
    data = np.frombuffer(b"one two one two", np.uint8)
    h = hash_spans(data, np.array([0, 8, 4]), np.array([7, 15, 11]))
    assert h[0] == h[1] != h[2]
