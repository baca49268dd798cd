"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [[norm(r[c]) for c in columns] for r in df.collect()]
    relation = con.execute(registry.ORACLES[name])
    order = [[d[0] for d in relation.description].index(c) for c in columns]
    want = [[norm(r[i]) for i in order] for r in relation.fetchall()]
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key(want)
