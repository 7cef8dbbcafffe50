"""Every registered query against its SQL on the smallest driver tables."""

import decimal
import math

import duckdb
import pytest

from sluice.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want


@pytest.mark.parametrize(("name", "sketch"), [("agg_hll", "hll_sketch_agg"), ("agg_tdigest", "kll_sketch_agg_double")])
def test_sketch_queries_notice_lost_rows(spark, monkeypatch, name, sketch):
    from pyspark.sql import functions as F

    assert [r["ok"] for r in catalog.queries()[name](spark, SF).collect()] == [True]
    whole = getattr(F, sketch)
    monkeypatch.setattr(F, sketch, lambda c: whole(F.when(F.pmod(F.hash(c), F.lit(4)) > 0, c)))
    assert [r["ok"] for r in catalog.queries()[name](spark, SF).collect()] == [False]
