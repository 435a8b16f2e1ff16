"""Operators that SQL can express give the same rows in an independent engine; every operator has a query."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm import queries
from tessera.llm.storage import checkpoint_dir, clear_staged, staged

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


def test_every_operator_and_the_pipeline_have_a_query():
    names = entry.queries()
    assert {q.split("_")[0] for q in names if q.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names


def test_staged_tables_can_be_cleared(spark):
    df = staged(spark.range(5), "t")
    assert df.count() == 5 and df._staged_path.startswith(checkpoint_dir(spark))
    clear_staged(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
