import os

import duckdb
import pytest

from tidelog.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    found = queries.queries()[name](spark, FOLDER)
    expected = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, expected.fetchall()))
