"""Each registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from strandframe.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def table(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toPandas()
    assert table(mine) == table(duck.execute(registry.oracle_sql()[name]).fetchdf())


def test_every_query_has_a_builder():
    assert set(registry.oracle_sql()) <= set(registry.queries())
