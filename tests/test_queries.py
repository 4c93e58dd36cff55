"""Every registered query of the engine against its SQL, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from quarryline.plans import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, duck, name):
    df = engine.QUERIES[name](spark, sf)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in engine.ORACLES:
        assert found[1]
        return
    cursor = duck.execute(engine.ORACLES[name])
    assert found == rows([c[0] for c in cursor.description], cursor.fetchall())
