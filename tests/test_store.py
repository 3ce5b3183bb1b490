"""SQL functions, documents by chunk, encryption and write-back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronofold.functions.session import register
from chronofold.sources import store
from chronofold.sources.documents import chunk_documents


def test_functions_for_sql(spark):
    register(spark)
    row = spark.sql("SELECT bt_state(NULL, TIMESTAMP_NTZ'2024-01-01') AS s, decay(30D, 30D) AS d, rrf(1) AS r, token_estimate('abcde') AS t, entity_key('The Acme, Inc.') AS e, size(hash_embed('x')) AS n").first()
    assert (row.s, row.d, round(row.r, 6), row.t, row.e, row.n) == ("ended", 0.5, round(1 / 61, 6), 2, "acme", 512)
    assert [r.object for r in spark.sql("SELECT * FROM fast_extract('I live in Oslo.')").collect()] == ["Oslo"]
    assert spark.sql("SELECT * FROM chunk_text('one. two.')").count() == 1
    live = "bt_live(TIMESTAMP_NTZ'2024-01-01', NULL, TIMESTAMP_NTZ'2024-01-01', NULL, TIMESTAMP_NTZ'2024-02-01', TIMESTAMP_NTZ'{}')"
    assert spark.sql(f"SELECT {live.format('2024-02-01')} AS a, {live.format('2023-02-01')} AS b").first() == (True, False)


def test_documents_change_by_chunk(spark):
    text = "\n".join(f"This is line number {i} of the document, long enough to count." for i in range(80))
    old = chunk_documents(spark.createDataFrame([("a", text), ("b", "other")], "id string, text string"), "id", "text")
    after, changes = store.add_documents(old, spark.createDataFrame([("a", text + "\nOne more line.")], "id string, text string"))
    kinds = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    assert kinds["kept"] >= old.count() - 2 and kinds.get("added", 0) <= 2
    assert {r.id for r in after.collect()} == {"a", "b"}


def test_deleting_sources_orphans_claims(spark):
    claims = spark.createDataFrame([("1", ["x"]), ("2", ["x", "y"]), ("3", [])], "id string, sources array<string>")
    got = {r.id: (r.sources, r.orphaned) for r in store.delete_documents(claims, spark.createDataFrame([("x",)], "id string")).collect()}
    assert got == {"1": ([], True), "2": (["y"], False), "3": ([], False)}


def test_write_back_sees_changes(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "z", 1)], "id int, v string, n int")
    assert sorted(r.id for r in store.changed_since(a, b, "id").collect()) == [2, 3, 4]


def test_sealed_columns(spark):
    key = F.lit(bytearray(range(32)))
    row = spark.createDataFrame([("secret",)], "t string").withColumn("c", store.seal(F.col("t"), key)).withColumn("p", store.unseal(F.col("c"), key)).first()
    assert row.p == "secret" and b"secret" not in bytes(row.c)
    with pytest.raises(ValueError):
        store.page_of(spark.range(3), [F.col("id")], 0)
