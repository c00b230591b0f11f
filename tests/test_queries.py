"""Every registered query of the log engine against its DuckDB SQL, and the entry contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from emberlog.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "documents", "pages", "orders"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(cols, found):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(([fix(r[c]) for c in cols] for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [*catalog.ORACLES])
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in got.fetchall()]
    assert rows(sorted(names), [r.asDict() for r in df.collect()]) == rows(sorted(names), want)


def test_chain_match_with_more_open_chains_than_the_cap(spark, tmp_path):
    c = duckdb.connect()
    kinds = "CASE WHEN k < 150 THEN 'signup' WHEN k % 3 = 0 THEN 'purchase' WHEN k % 3 = 1 THEN 'error' ELSE 'signup' END"
    c.execute(f"copy (select k as event_id, timestamp '2024-01-01' + to_seconds(k) as ts, k % 7 as user_id, {kinds} as event_type, '{{}}' as props from range(400) t(k)) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as from '{tmp_path}/events.parquet'")
    want = dict(c.execute(f"select line_number, chain_id from ({catalog.ORACLES['chain_match']})").fetchall())
    got = {r["line_number"]: r["chain_id"] for r in catalog.QUERIES["chain_match"](spark, str(tmp_path)).collect()}
    assert "signup-buy-fail-150" in want.values() and got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
