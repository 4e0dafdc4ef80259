"""Every query that has SQL is run by both engines over the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def cells(rows, names):
    num = lambda v: round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(str(tuple(num(r[n]) for n in names)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == names
    assert cells([r.asDict() for r in df.collect()], names) == cells([dict(zip(cols, r, strict=True)) for r in cursor.fetchall()], names)
