"""Every query that has SQL gives the SQL's rows; the others run and keep their schema."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestrata.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def cell(v):
        if isinstance(v, np.ndarray):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(cell(x) for x in v) + "]"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
            return ""
        return format(float(v), ".9g") if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), sql.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_parents_are_packed_for_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '\\S'").count()
    got = catalog.QUERIES["parent_pack_budget"](spark, SF).toPandas()
    assert got.query_id.nunique() == len(got) == docs > 64


def test_entry_imports_without_optional_parts():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_what_the_optional_part_needs():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    n, m, optional = got.stdout.split()[-3:]
    assert (int(n), int(m), optional) == (len(catalog.QUERIES), len(catalog.ORACLES), "False")
