"""Unit vectors to the last bit of their SQL, where rounding and lengths are odd."""

from __future__ import annotations

import pytest

from chronofold.plans import catalog

NAN, INF = float("nan"), float("inf")
CASES = {
    "zeros keep their sign": [[1.0, -1e-9], [-1e-9, 1.0, 1e-9], [1.0, -0.0], [-5.0001e-7, 1.0]],
    # norms of 640, 1280 and 3200: the first quotient ends in a 5 in the seventh decimal, which the double times 10^6 just misses; of 128: it meets it
    "halves": [[41.0, 638.0, 29.0, 5.0, 3.0], [-646.0, 1105.0, 7.0, 3.0, 1.0], [207.0, 3193.0, 43.0, 7.0, 2.0], [1.0, 127.0, 15.0, 5.0, 2.0]],
    "null elements": [[None, 3.0, -4.0], [3.0, None], [None, 0.0], [None, None]],
    "no direction": [None, [], [0.0, 0.0], [-0.0]],
    "not finite, largest, least": [[NAN, 1.0], [INF, 1.0, -2.0], [3.4e38, -3.4e38], [1e-45, -1e-45]],
}


@pytest.mark.parametrize("case", CASES)
def test_unit_vectors_are_their_sql_bit_by_bit(case, spark, tmp_path):
    con = pytest.importorskip("duckdb").connect()
    rows = [(k, v) for k, v in enumerate(CASES[case])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(catalog.oracle_sql()["unit_vectors"]).fetchall()))
    got = sorted(repr((r.id, r.unit)) for r in catalog.queries()["unit_vectors"](spark, str(tmp_path)).collect())
    assert got == want
