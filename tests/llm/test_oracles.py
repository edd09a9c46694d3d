"""Registered queries against their SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexiquarry.llm import queries


def compared(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    got, want = queries.queries()[name](spark, str(folder)), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    return Counter(map(tuple, got.select(*columns).collect())), Counter(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    got, want = compared(spark, "/root/testdata/sf0.01", name)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql_on_odd_rows(spark, tmp_path, name):
    near = [" ".join(f"w{k}" for k in range(60) if k != j) for j in range(0, 60, 7)]
    texts = [None, "", " \t", "one", "ONE", "two words", "Two\nWords", *near, near[0].upper(), "É é", "é É", "x " * 500]
    docs = [(k, t, ["a", "", None, "b"][k % 4 if k > 3 else 0], "en") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    r = np.random.default_rng(2)
    some = [r.normal(size=4).tolist() for _ in range(30)]
    vecs = [None, [], [0.0] * 4, [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], *some, *some[:5]]
    spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = compared(spark, tmp_path, name)
    assert got == want and got
