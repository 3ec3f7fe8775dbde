"""The queries of this round's plans against their SQL on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import decision_queries, null_queries, reader_queries, tree_queries

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in entry._parts()[0].items() if f.__module__ in {m.__name__ for m in (decision_queries, null_queries, reader_queries, tree_queries)} and n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("customer", "embeddings", "events", "lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql(spark, con, name):
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    df = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(plain(v) for v in r) for r in want.fetchall()) and (got or name == "tag_gene_containment")  # no site in a listed gene there
