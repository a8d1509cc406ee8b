"""Each registered query against its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans import queries as plans
from tidemark.plans import reports, studies  # noqa: F401  register their queries

AT = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 4) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, AT)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in plans.ORACLE_SQL:
        cur = duck.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cur.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
