"""Every query of the engine against its DuckDB counterpart, on small tables."""

import os

import duckdb
import pytest

from keytide.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def con(small):
    out = duckdb.connect()
    out.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            out.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, small, name):
    df = catalog.QUERIES[name](spark, small)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr) == want


def test_entry_survives_without_optional_parts(spark, monkeypatch):
    import __spark_entry__ as entry

    assert {"kv_replay", "fraud_score"} <= set(entry.queries())
    monkeypatch.setattr(entry, "llm", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)
    assert entry.entry(spark).count() > 0
