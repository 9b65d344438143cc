"""The registered queries: against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from skein.llm import decontam, neardup, pii, quality
from skein.llm.queries import QUERIES, SQL
from tests import compare


def test_all_ten_are_there():
    import __spark_entry__

    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_agree(spark, data, name):
    assert compare.differ(QUERIES[name](spark, data), compare.database(data), SQL[name]) == ""


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench, labels = spark.read.parquet(f"{data}/benchmark.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.cut(stage(spark, now, data), f"test-{name}")
        assert now.columns == docs.columns
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        own = {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality":
            assert kept[name] == {r.id for r in quality.quality_scores(before, labels).collect() if r.score >= 0.3}
        elif name == "near_dedup":
            assert kept[name] == {r.doc_id for r in neardup.near_duplicates(before).collect() if r.doc_id == r.component_id}
        elif name == "decontamination":
            assert kept[name] == own - {r.doc_id for r in decontam.contamination(before, bench).collect() if r.n_hit and 20 * r.n_hit >= r.n_words}
        else:
            assert kept[name] == own
            assert {r.doc_id: r.text for r in now.collect()} == {r.doc_id: r.text for r in pii.redact(before).collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, data).collect()
    assert {p.doc_id for p in pieces} == kept["pii"]
    assert len(corpus_pipeline.run(spark, data).collect()) == len(pieces)


def test_stages_judge_rows_without_an_id_by_their_texts(spark, tmp_path):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (3, text[2]), (None, text[2]), (None, text[4]), (None, text[4]), (5, None), (None, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source int")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    got = {r.source for r in kept.collect()}
    assert kept.columns == docs.columns and got in ({0, 1, 3, 4, 8, 9, x} for x in (6, 7))
    spark.createDataFrame([(1, text[0]), (2, text[3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r.source for r in clean.collect()} == {1, 2, 4, 5, 6, 7, 8, 9}


def test_pipeline_of_nothing(spark, data):
    now = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, data)
        assert now.count() == 0
