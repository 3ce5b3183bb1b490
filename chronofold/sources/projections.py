"""The bundled tables seen as claims, turns, edges and documents, in Spark and as SQL for the side-by-side check.

Nothing here is materialised: each view is a projection of one scan, so filters and column choices reach Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n: Column | str) -> Column:
    return F.make_dt_interval(F.expr(n) if isinstance(n, str) else n)


def claims_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims with both clocks stated."""
    e = table(spark, sf_dir, "events")
    slot = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = e.withColumn("valid_to", F.lead("ts").over(slot))
    subject = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    obj = F.regexp_extract("props", "([0-9]+)", 1)
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("id"), F.lit("default").alias("tenant"), F.col("user_id").cast("string").alias("usr"),
        subject.alias("subject"), F.col("event_type").alias("predicate"), obj.alias("object"),
        F.col("ts").alias("valid_from"), "valid_to", (F.col("ts") + _days("event_id % 7")).alias("recorded_at"),
        F.when(F.col("event_id") % 11 == 0, F.col("ts") + _days("event_id % 7 + 3")).alias("invalidated_at"),
        F.when(F.col("event_id") % 97 == 0, F.col("ts") + _days("30")).alias("expires_at"),
        (F.lit(0.5) + (F.col("event_id") % 6) / 10.0).alias("confidence"), F.lit(1).alias("polarity"), "value", "props", "event_id",
        F.concat_ws("|", subject, F.col("event_type")).alias("fact_key"), F.concat_ws("|", subject, F.col("event_type"), obj).alias("value_key"),
    )


CLAIMS_EV = """claims_ev AS (
  SELECT 'ev_' || event_id AS id, 'default' AS tenant, user_id::VARCHAR AS usr, 'user:' || user_id AS subject, event_type AS predicate,
    regexp_extract(props, '([0-9]+)', 1) AS object, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to,
    ts + to_days((event_id % 7)::INT) AS recorded_at, CASE WHEN event_id % 11 = 0 THEN ts + to_days((event_id % 7 + 3)::INT) END AS invalidated_at,
    CASE WHEN event_id % 97 = 0 THEN ts + to_days(30) END AS expires_at, 0.5::DOUBLE + (event_id % 6) / 10.0::DOUBLE AS confidence, 1 AS polarity, value, props, event_id,
    'user:' || user_id || '|' || event_type AS fact_key, 'user:' || user_id || '|' || event_type || '|' || regexp_extract(props, '([0-9]+)', 1) AS value_key
  FROM events)"""


def claims_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims at levels of scope: user, agent and, for two of three orders, session."""
    o = table(spark, sf_dir, "orders")
    subject = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    return o.select(
        F.concat(F.lit("or_"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("default").alias("tenant"), F.col("o_custkey").cast("string").alias("usr"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("agent"),
        F.when((F.col("o_orderkey") % 5 != 0) & (F.col("o_orderkey") % 3 != 0), (F.col("o_orderkey") % 3).cast("string")).alias("session"),
        subject.alias("subject"), F.lit("order_status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("valid_from"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("order_key"), F.concat_ws("|", subject, F.lit("order_status")).alias("fact_key"),
    )


CLAIMS_OR = """claims_or AS (
  SELECT 'or_' || o_orderkey AS id, 'default' AS tenant, o_custkey::VARCHAR AS usr, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS agent,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN (o_orderkey % 3)::VARCHAR END AS session, 'customer:' || o_custkey AS subject,
    'order_status' AS predicate, o_orderstatus AS object, o_orderdate AS valid_from, o_totalprice AS amount, o_orderkey AS order_key, 'customer:' || o_custkey || '|order_status' AS fact_key
  FROM orders)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        F.concat_ws("_", F.lit("ep"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("session"), "conv_id", "turn",
        "role", F.col("text").alias("content"), (start + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))).alias("ts"),
        F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("role"), F.col("text")), 256).alias("hash"),
    )


EPISODES = """episodes AS (
  SELECT 'ep_' || conv_id || '_' || turn AS id, conv_id::VARCHAR AS session, conv_id, turn, role, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts, sha256(conv_id::VARCHAR || chr(31) || role || chr(31) || text) AS hash
  FROM conversations)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a graph: src, predicate, tgt, confidence."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def of(df: DataFrame, src: Column, predicate: str, tgt: Column, confidence: float) -> DataFrame:
        return df.select(src.alias("src"), F.lit(predicate).alias("predicate"), tgt.alias("tgt"), F.lit(confidence).alias("confidence"))

    out = of(t("nation"), node("nation", "n_nationkey"), "in_region", node("region", "n_regionkey"), 1.0)
    for name, key, nation, predicate, conf in (("customer", "c_custkey", "c_nationkey", "located_in", 0.9), ("supplier", "s_suppkey", "s_nationkey", "located_in", 0.8)):
        out = out.unionAll(of(t(name), node(name, key), predicate, node("nation", nation), conf))
    return out.unionAll(of(t("orders"), node("customer", "o_custkey"), "placed", node("order", "o_orderkey"), 0.7))


EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'in_region' AS predicate, 'region:' || n_regionkey AS tgt, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 0.9 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 0.8 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey, 0.7 FROM orders)"""
