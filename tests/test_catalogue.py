import glob
import os

import duckdb
import pytest

from docsift.plans import catalogue, rendered  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        path = path if os.path.isfile(path) else sorted(glob.glob(f"{path}/*"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({path!r})")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, oracle, name):
    got = catalogue.QUERIES[name](spark, sf).toArrow()
    columns = sorted(got.schema.names)
    assert columns and got.num_rows >= 0
    if name not in catalogue.ORACLE:
        return
    want = oracle.execute(catalogue.ORACLE[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert columns == sorted(names)
    mine = sorted(map(repr, zip(*[got[c].to_pylist() for c in columns], strict=True)))
    theirs = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in rows)
    assert mine == theirs


def test_entry_runs_and_names_agree(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
