"""query_expansion walks the graph of all entities, however many have more mentions than its centre."""

import duckdb
import pandas as pd

from lodestrata.operators import entities as en
from lodestrata.plans import catalog


def word(i: int) -> str:
    return "Often" + "".join(chr(97 + int(d)) for d in f"{i:02d}")


def test_expansion_reaches_entities_beyond_the_most_mentioned(spark, tmp_path):
    lines = [word(i) for i in range(60)] * 6 + [f"{word(0)} {word(1)}"] * 2 + ["Rarely Seldom x"] * 4 + ["Seldom and Hardly"] * 3
    docs = pd.DataFrame({"doc_id": range(20), "text": ["\n".join(lines[i::20]) for i in range(20)], "lang": "en", "source": "s", "n_chars": 1})
    docs.to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["query_expansion"](spark, str(tmp_path)).collect()]
    assert got == c.sql(catalog.ORACLES["query_expansion"]).fetchall() == [("rarely::cap\n\nRelated entities for retrieval: Seldom, Hardly",)]
    first = catalog.QUERIES["graph_edges"](spark, str(tmp_path)).select("source", "target", "weight")  # a graph of 50 nodes by its own rule
    assert [tuple(r) for r in first.collect()] == [("oftenaa::cap", "oftenab::cap", 2)]


def test_no_row_holds_all_pairs_of_a_chunk(spark):
    found = spark.range(40).selectExpr("1 as doc_id", "1 as ord", "concat('n', char(97 + id div 26), char(97 + id % 26)) as text", "'CAP' as kind")
    edges = en.co_occurrence(found, least=1)
    assert edges.count() == 40 * 39 / 2 and edges.where("source < target and weight = 1").count() == 40 * 39 / 2
    assert "flatten(" not in edges._jdf.queryExecution().optimizedPlan().toString()
