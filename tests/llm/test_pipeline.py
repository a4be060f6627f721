"""The pipeline's stages take effect, and its rows equal a plain run over the same documents."""

import pytest

import corpus_pipeline
from tests.llm.cases import words
from tidemark.llm import queries

ITEM = words(900, 40)


@pytest.fixture()
def folder(spark, tmp_path):
    docs = [(k, words(k, 60 + k), "en", "s", 0) for k in range(30)]
    docs += [(100, "too short", "en", "s", 0), (101, words(3, 63), "en", "s", 0), (102, f"{words(40, 50)} {ITEM}", "en", "s", 0), (103, words(41, 50) + " me@x.org", "en", "s", 0), (104, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {*range(30), 101, 102, 103} and seen[1] == seen[0] - {101} and seen[2] == seen[1] - {102} == seen[3]
    assert docs.where("doc_id = 103").collect()[0].text.endswith("[EMAIL]")
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == seen[3] and packed.agg({"sequence_id": "max"}).collect()[0][0] >= 0


def test_every_corpus_query_is_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and len(corpus_pipeline.STAGES) == 5
