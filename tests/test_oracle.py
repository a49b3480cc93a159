"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from quillmill.plans import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return repr(round(float(v), 9)) if isinstance(v, (float, np.floating)) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    want = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)  # nulls do not compare with strings


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_native_operators_have_no_python_in_their_plans(spark, sf_dir):
    python = ("patch_apply", "page_text", "chunked_extract", "merge_articles", "pack_batches", "task_replay", "rewritten_questions", "written_articles", "cited_answers", "derived_documents", "breaker_trace", "cache_toggle", "serial_classes")
    for name in sorted(set(QUERIES) - set(python)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["offtopic_diff"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0] and "PushedFilters" in plan
