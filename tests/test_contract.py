import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in frame.itertuples(index=False, name=None))


def test_entry_has_a_result(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    got, want = catalog.queries()[name](spark, FOLDER).toPandas().astype(object), db.sql(catalog.oracle_sql()[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_without_the_llm_subpackage():
    text = "".join(open(os.path.join(folder, f)).read() for folder, _, fs in os.walk(os.path.dirname(catalog.__file__) + "/..") if "llm" not in folder for f in fs if f.endswith(".py"))
    assert "strandloom.llm" not in text
