"""The thin queries on small tables."""

import numpy as np

from gleaner.llm import decontam, queries

rng = np.random.default_rng(3)


def prose(n: int) -> str:
    return " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)) + "."


def test_span_dedup_query_removes_repeats_inside_one_document(spark, tmp_path):
    verse = prose(60)
    own = prose(40)
    rows = [(1, f"{verse} {own} {verse}"), (2, prose(50))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op8_span_dedup(spark, str(tmp_path)).collect()}
    assert out[1].n_removed > 0 and out[1].text.startswith(f"{verse} {own}")
    assert len(out[1].text.split()) < 60 + 40 + 30
    assert out[2].text == rows[1][1] and out[2].n_removed == 0


def test_latent_space_is_fitted_on_all_documents(spark):
    """Counts and range matrix against plain ones over more documents than the former sample of 20 000."""
    words = [f"w{k}" for k in range(12)]
    items = decontam.read_items([(1, " ".join(words[:8])), (2, " ".join(words[4:]))])
    texts = [" ".join(rng.choice([*words, "other"], int(n))) for n in rng.integers(0, 6, 24_000)] + [" ".join(rng.choice(words, 200))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    number = {w: int(items.of(decontam.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[1][0]) for w in words}
    x = []
    for t in texts:
        own = t.split()
        for at in range(0, len(own), decontam.WINDOW):
            x.append(np.bincount([number[w] for w in own[at : at + decontam.WINDOW] if w in number], minlength=12))
    x = np.array(x, float)
    shares = docs.select("text").mapInArrow(lambda it: decontam.measured(it, items), "part int, y binary").repartition(decontam.PARTS, "part").mapInArrow(decontam.added, "part int, y binary").collect()
    parts = {r.part: np.frombuffer(r.y, np.float64) for r in shares}
    assert parts[-1].tolist() == [*(x > 0).sum(0), len(x)]
    omega = decontam.test_matrix(12)
    y = np.concatenate([parts[k] for k in range(decontam.PARTS)]).reshape(omega.shape)
    assert np.allclose(y, x.T @ (x @ omega), rtol=1e-3, atol=1)
    df = (x > 0).sum(0) + (items.counts() > 0).sum(0)
    assert np.allclose(decontam.fit(docs, items).idf, np.maximum(0, np.log((len(x) + 2 - df + 0.5) / (df + 0.5))))
