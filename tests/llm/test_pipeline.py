"""The pipeline's stages on a small table against what they must keep."""

import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_stages(spark):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        kept[name] = docs.count()
    assert before >= kept["quality classifier"] >= kept["toxicity"] >= kept["line dedup"] >= kept["n-gram Jaccard join"] > before // 2
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert all(c == d for d, (_, c) in brute_components(rows).items())
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept["n-gram Jaccard join"]


def loaded():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    return pipeline


def test_of_copies_one_document_reaches_packing(spark):
    stages = dict(loaded().STAGES)
    text = "\n".join(f"line number {w} of a text with copies" for w in ("one", "two", "three"))
    rows = [(i, text) for i in range(5)] + [(7, ""), (8, None), (9, " \n"), (10, text.replace("\n", " "))]
    docs = stages["line dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 7, 8, 9, 10]
    docs = stages["n-gram Jaccard join"](spark, spark.createDataFrame(docs.toPandas(), docs.schema), SF)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 7, 8, 9]
    got = stages["best-fit packing"](spark, spark.createDataFrame(docs.toPandas(), docs.schema), SF).collect()
    assert sorted((r.doc_id, r.length == 1) for r in got) == [(0, False), (7, True), (8, True), (9, True)]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("line", F.lit("own"))
    before = docs.columns
    for _, stage in loaded().STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = loaded().STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in packed) == (["1", "2", "None"] if rows else [])
