"""The pipeline on the smallest tables: what each stage must keep and drop."""

import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from gleaner.llm import common, decontam, queries, toxicity
from gleaner.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_stages_keep_the_schema(stages):
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes


def test_no_benchmark_passage_is_left(spark, stages):
    level = lambda t: re.sub(r"\s+", " ", t.lower())
    items = [level(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in level(r.text) for r in stages[4].collect() for i in items)


def test_one_of_each_group_stays(stages):
    from tests.llm.test_operators import brute_components

    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {c for (_, n, c) in brute_components(before) if n}
    got = {r.doc_id for r in stages[3].collect()}
    assert want <= got and got - want == {d for (d, n, _) in brute_components(before) if not n}


def test_packing_holds_every_document(stages):
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].collect()}


def own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_workers_keep_no_freed_memory():
    pinned = []

    def work(batches):
        for batch in batches:
            parts = [np.ones(100_000, np.uint8) for _ in range(2000)]  # too small for mappings of their own
            pinned.append(parts.pop())  # what lies above the freed ones
            del parts
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    before = own_mb()
    assert [b.num_rows for b in common.lean(work)(iter([batch]))] == [1]
    assert own_mb() - before < 50  # of 200


def test_decontamination_gives_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    tasks, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    decontam.row_leaks(table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    for task in tasks:
        list(task(iter([])))
    assert len(tasks) == len(given) == 3


def test_driver_keeps_no_freed_memory(spark):
    jvm = spark._jvm
    smaps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def jvm_mb() -> float:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", smaps.read_text())[1]) / 1024

    materialize(spark.range(10), "first")
    used = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # the JVM's memory outside its heap
    full = jvm_mb()
    for x in used[:-1]:  # the last stays, above the freed ones
        x.end()
    materialize(spark.range(10), "second")
    assert full - jvm_mb() > 60  # of about 120
    used[-1].end()


def test_toxicity_stage_gives_the_drivers_memory_back(spark, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "train", lambda *a, train=toxicity.train: done.append("train") or train(*a))
    monkeypatch.setattr(toxicity, "relieve", lambda spark: done.append("relieve"))
    toxicity.keep_clean(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert done == ["relieve", "train", "relieve"]


def test_ten_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
