"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from sigmill import plans

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(round(float(v[k]), 6) + 0.0 if isinstance(v[k], float) and not math.isnan(v[k]) else v[k] for k in order) for v in values]
    return sorted(columns), sorted(out, key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


#: Tested against a plain version, and on rows that weren't learned from, in test_learning.py.
WITHOUT_SQL = {"language_naive_bayes", "language_logistic", "language_forest", "component_naive_bayes", "component_logistic", "component_forest", "security_svm", "security_boosting"}


def test_all_have_sql():
    assert set(plans.queries()) - WITHOUT_SQL == set(plans.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(name, spark, db):
    found = plans.queries()[name](spark, DATA)
    want = db.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())
