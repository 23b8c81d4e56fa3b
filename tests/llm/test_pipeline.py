import re

import pytest

import corpus_pipeline
from equiscan.llm import decontamination, quality_classifier
from test_jaccard import brute
from test_scans import brute_contamination


@pytest.fixture(scope="module")
def stages(spark, small, documents, tmp_path_factory):
    """What each stage returned, written and read as the pipeline does."""
    out, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_documents(stages, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    assert all(s.columns == documents.columns and s.dtypes == documents.dtypes for s in stages[:-1])


def test_quality_stage_drops_what_the_classifier_rejects(spark, small, stages):
    scores = quality_classifier.score_documents(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    assert ids(stages[1]) == ids(scores.where("predicted = 1"))


def test_join_stage_keeps_the_smallest_id_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted(i for i, _, smallest in brute(rows, 5, 80) if i == smallest)


def test_decontamination_stage_keeps_clean_documents(spark, small, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = []
    for r in stages[2].collect():
        n, hit, _ = brute_contamination(r.text, items)
        clean += [r.doc_id] if not (hit and 20 * hit >= n) else []
    assert ids(stages[3]) == sorted(clean)


def test_pii_stage_keeps_every_document_and_packing_every_one_of_them(stages):
    assert ids(stages[3]) == ids(stages[4])
    before = {r.doc_id: r.text for r in stages[3].collect()}
    addresses = re.compile(r"[\w.]+@mail[0-9]\.example\.com")
    assert any(addresses.search(t) for t in before.values())
    for r in stages[4].collect():
        assert r.n_chars == len(r.text)
        assert not any(a in r.text for a in addresses.findall(before[r.doc_id]))
    assert sorted(r.doc_id for r in stages[5].where("piece = 0").select("doc_id").collect()) == ids(stages[4])


def test_run_is_the_stages_in_order(spark, small, stages):
    got = corpus_pipeline.run(spark, small).select("doc_id", "piece", "length").collect()
    assert sorted(got) == sorted(stages[5].select("doc_id", "piece", "length").collect())


def test_repeated_ids_null_ids_and_empty_tables(spark, small, messy, no_documents):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns
    assert ids(kept.where("doc_id IS NOT NULL")) == [1, 2, 3, 4, 5, 8, 9, 10, 11] and kept.where("doc_id IS NULL").count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, small).isEmpty()
    assert corpus_pipeline.decontaminate(spark, docs, small).count() == docs.count()
    assert decontamination.WINDOW == 13
