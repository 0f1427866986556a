"""Every registered training-data query on the small tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest

queries = pytest.importorskip("strandweave.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in queries.SQL:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())
