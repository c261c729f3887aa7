"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "inf" if math.isinf(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(str(cell(r[c])) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(str(cell(r[i])) for i in at) for r in rel.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_text_search_embeds_at_the_engines_dimension(spark, data, monkeypatch):
    from siftspark.config import Config
    from siftspark.operators import vectors
    from siftspark.plans import catalogue

    seen, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda asked, rows, *a: seen.extend(len(x.first()["vector"]) for x in (asked, rows)) or nearest(asked, rows, *a))
    assert catalogue.hybrid_text_search(spark, data).count()
    assert seen == [Config().embedding_dim] * 2
