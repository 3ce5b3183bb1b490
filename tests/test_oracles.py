"""Every query with a SQL equivalent gives the same rows as that SQL, on the small tables."""

from __future__ import annotations

import math
import os

import pytest

from chronofold.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, sf, con):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted("|".join(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert catalog.FLAGSHIP in catalog.queries()
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
