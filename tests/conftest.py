import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import get_spark, ship

    s = get_spark(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    ix = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(repr(tuple(_norm(r[i]) for i in ix)) for r in rel.fetchall())
