"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexiquarry.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    as_text = lambda x: repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return columns, sorted("|".join(map(as_text, row)) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sql, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(sql.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "title", "snippet", "score", "raw_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_postings_filter_reaches_the_scan(spark, tmp_path):
    from lexiquarry.operators import index as ix, search

    registry.built(spark, SF).save(str(tmp_path))
    stored = ix.Index.load(spark, str(tmp_path))
    plan = search.prefix_docs(stored, "th")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,th)" in plan and "positions" not in plan.split("ReadSchema")[1]
    assert search.exact(stored, "the").count() == search.exact(registry.built(spark, SF), "the").count()


def test_a_term_query_on_a_stored_index_shuffles_only_to_sort(spark, tmp_path):
    from lexiquarry.operators import index as ix, search

    registry.built(spark, SF).save(str(tmp_path))
    stored = ix.Index.load(spark, str(tmp_path))
    plan = search.exact(stored, "the")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0 and plan.count("Exchange SinglePartition") == 0
    assert plan.count("FileScan") == 3 and "doc_stats" not in plan
    want = search.exact(registry.built(spark, SF), "the").collect()
    assert search.exact(stored, "the").collect() == want
