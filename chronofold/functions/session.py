"""The library's functions for SQL: bodies in SQL where SQL can say it, table functions for what makes several rows of one."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chronofold.functions.language import facts, hash_embed
from chronofold.functions.text import entity_key_udf
from chronofold.sources.documents import chunks

# SQL functions by signature and body. The optimizer sees through them, so filters still reach the scan.
SQL_FUNCTIONS = {
    "bt_live(recorded_at TIMESTAMP_NTZ, invalidated_at TIMESTAMP_NTZ, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, k TIMESTAMP_NTZ, v TIMESTAMP_NTZ) RETURNS BOOLEAN": "recorded_at <= k AND (invalidated_at IS NULL OR invalidated_at > k) AND valid_from <= v AND (valid_to IS NULL OR valid_to > v)",
    "bt_state(invalidated_at TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ) RETURNS STRING": "CASE WHEN invalidated_at IS NOT NULL THEN 'retired' WHEN valid_to IS NOT NULL THEN 'ended' ELSE 'live' END",
    "decay(age_days DOUBLE, half_life DOUBLE) RETURNS DOUBLE": "power(0.5D, greatest(0D, age_days) / half_life)",
    "rrf(rank_from_1 INT) RETURNS DOUBLE": "1D / (60 + rank_from_1)",
    "token_estimate(x STRING) RETURNS BIGINT": "ceil(length(x) / 4)",
}


class ChunkText:
    def eval(self, text: str):
        for k, c in enumerate(chunks(text)):
            yield k, c


class FastExtract:
    def eval(self, text: str):
        for predicate, obj, polarity, when in facts(text or ""):
            yield predicate, obj, polarity, when


def register(spark: SparkSession) -> None:
    """Make the functions known to this session."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("entity_key", entity_key_udf)
    spark.udf.register("hash_embed", hash_embed, "array<float>")
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="position int, chunk string"))
    spark.udtf.register("fast_extract", udtf(FastExtract, returnType="predicate string, object string, polarity int, said_when string"))
