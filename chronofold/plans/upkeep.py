"""Ingestion, metadata filters, maintenance, reconciliation and streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.functions import text as TX
from chronofold.functions.filters import meta_filter, path_prefix
from chronofold.operators import maintenance as M
from chronofold.operators import reconcile as RC
from chronofold.plans.registry import query
from chronofold.sources import documents as D
from chronofold.sources.projections import CLAIMS_EV, EPISODES, claims_ev, episodes, table
from chronofold.streaming import latest_state

AT, NOW = "2024-01-15 00:00:00", "2024-02-20 00:00:00"


@query(None)
def html_text(spark, sf_dir):
    return D.read_html(table(spark, sf_dir, "pages"), "page_id", "html")


@query(None)
def chunk_documents(spark, sf_dir):
    return D.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(None)
def chunk_diff(spark, sf_dir):
    """A document against its version without the first line."""
    docs = table(spark, sf_dir, "documents")
    old = D.chunk_documents(docs, "doc_id", "text")
    new = D.chunk_documents(docs.withColumn("text", F.regexp_replace("text", r"^[^\n]*\n", "")), "doc_id", "text")
    return D.chunk_diff(old, new)


_FILL = "[" + ", ".join(f"'{w}'" for w in TX.FILLERS) + "]"


GATE_SQL = f"""WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(role, 'user'))) AS role, trim(coalesce(text, '')) AS x FROM conversations),
  w AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')), '\\s+'), lambda a: a <> '') AS ws,
    list_filter(list_transform(regexp_extract_all(x, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM t)
  SELECT conv_id, turn, CASE WHEN x = '' THEN 'no_content' WHEN role <> 'user' THEN role || '_turn' WHEN len(ws) BETWEEN 1 AND 6 AND len(list_filter(ws, lambda a: NOT list_contains({_FILL}, a))) = 0 THEN 'ack_only'
    WHEN len(ws) < 2 THEN 'too_short' WHEN len(ss) > 0 AND len(list_filter(ss, lambda s: NOT ends_with(s, '?'))) = 0 THEN 'question' ELSE 'has_declarative' END AS reason FROM w"""


@query(GATE_SQL)
def salience_gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TX.gate_reason(F.col("text"), F.col("role")).alias("reason"))


@query(f"WITH {EPISODES} SELECT hash, min(id) AS first, count(*) AS copies FROM episodes GROUP BY hash")
def hash_dedupe(spark, sf_dir):
    return episodes(spark, sf_dir).groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))


@query(r"SELECT doc_id, length(regexp_replace(text, '\b[\w.%+''-]+@[\w-]+(?:\.[\w-]+)+\b', '[redacted:email]', 'g')) AS n FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b')")
def redact_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"))
    return d.select("doc_id", F.length(TX.redact_email(F.col("text"))).cast("long").alias("n"))


@query(None)
def redact_pii(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("clean", TX.redact(F.col("text")))
    return d.filter("clean <> text").select("doc_id", "clean")


@query(f"WITH {CLAIMS_EV} SELECT id FROM claims_ev WHERE props IS NOT NULL AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) IN (7, 11) AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def meta_filter_typed(spark, sf_dir):
    return claims_ev(spark, sf_dir).filter(meta_filter(F.col("props"), {"k": [7, 11]})).select("id")


@query("SELECT doc_id, source || '/' || doc_id AS filepath FROM documents WHERE starts_with(source || '/' || doc_id, 'src1/')")
def filepath_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("filepath", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return d.filter(path_prefix(F.col("filepath"), "src1/")).select("doc_id", "filepath")


@query(f"""WITH {CLAIMS_EV} SELECT id, CASE WHEN predicate = 'error' AND invalidated_at IS NULL AND recorded_at <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') THEN TIMESTAMP '{AT}'
  ELSE invalidated_at END AS invalidated_at FROM claims_ev""")
def forget_slots(spark, sf_dir):
    c = claims_ev(spark, sf_dir)
    return M.forget(c, c.filter("predicate = 'error'"), AT, AT).select("id", "invalidated_at")


@query(f"""WITH {CLAIMS_EV} SELECT id, CASE WHEN predicate = 'view' AND invalidated_at IS NULL AND (valid_to IS NULL OR greatest(TIMESTAMP '{AT}', valid_from) < valid_to) THEN greatest(TIMESTAMP '{AT}', valid_from) ELSE valid_to END AS valid_to FROM claims_ev""")
def end_slots(spark, sf_dir):
    return M.close_out(claims_ev(spark, sf_dir), F.col("predicate") == "view", AT, "ended").select("id", "valid_to")


def _stores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"))
    return {"claims": (o, "id"), "sources": (l, "claim_id")}, o.filter("id % 10 = 0")


@query("SELECT 'claims' AS store, count(*) AS kept FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'sources', count(*) FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def erase_claims(spark, sf_dir):
    stores, ids = _stores(spark, sf_dir)
    out = None
    for name, df in sorted(M.erase(stores, ids).items()):
        n = df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("store"), "kept")
        out = n if out is None else out.unionAll(n)
    return out


@query("SELECT unnest(['claims', 'sources']) AS store, 0::BIGINT AS residue")
def erase_and_prove(spark, sf_dir):
    stores, ids = _stores(spark, sf_dir)
    left = M.erase(stores, ids)
    return M.proof({k: (left[k], stores[k][1]) for k in stores}, ids)


@query(f"WITH {CLAIMS_EV} SELECT id FROM claims_ev WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'")
def expiry_sweep(spark, sf_dir):
    return claims_ev(spark, sf_dir).filter(C.unexpired_expr(NOW)).select("id")


@query(f"WITH {CLAIMS_EV} SELECT usr <> '7' AS kept, count(*) AS n FROM claims_ev GROUP BY 1")
def purge_scope(spark, sf_dir):
    from chronofold.operators.scope import contains

    inside = contains({"tenant": "default", "usr": "7"})
    return claims_ev(spark, sf_dir).groupBy((~inside).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLAIMS_EV}, m AS (SELECT subject, CASE predicate WHEN 'click' THEN 'view' ELSE predicate END AS predicate FROM claims_ev) SELECT subject || '|' || predicate AS fact_key, count(*) AS n FROM m GROUP BY 1")
def merge_predicate(spark, sf_dir):
    return M.merge_predicate(claims_ev(spark, sf_dir), {"click": "view"}).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLAIMS_EV} SELECT value_key, arg_max(id, (1 + event_id % 3, -epoch_us(recorded_at), id)) AS id, sum(1 + event_id % 3)::BIGINT AS obs_count, least(5.0, round(sum(confidence), 6)) AS salience, count(*) AS merged FROM claims_ev GROUP BY value_key")
def consolidate_values(spark, sf_dir):
    c = claims_ev(spark, sf_dir).withColumn("obs_count", 1 + F.col("event_id") % 3).withColumn("salience", F.col("confidence"))
    return M.merge_values(c)


@query(f"WITH {CLAIMS_EV} SELECT subject, predicate, object, count(*) AS n FROM claims_ev GROUP BY ALL HAVING count(*) >= 2")
def promote_episodic(spark, sf_dir):
    return M.promote(claims_ev(spark, sf_dir), 2)


@query("SELECT c_nationkey AS id FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def entity_gc(spark, sf_dir):
    """Entities (nations of customers) that no surviving row (of suppliers) mentions."""
    known = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")).distinct()
    return known.join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")), "id", "left_anti")


@query("SELECT p_partkey, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9]+', '_', 'g')) AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace(F.trim("p_name"), "[^A-Za-z0-9]+", "_")).alias("slug"))


@query(None)
def entity_keys(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", TX.entity_key_udf("p_name").alias("key"))


def _assertions(spark, sf_dir):
    c = claims_ev(spark, sf_dir)
    return c.select("subject", "id", "predicate", "object", F.when(F.col("event_id") % 13 == 0, -1).otherwise(1).alias("polarity"), "valid_from", F.col("recorded_at").alias("arrived_at"), "confidence")


@query(None)
def reconcile_fold(spark, sf_dir):
    got = RC.reconcile(_assertions(spark, sf_dir), {"signup", "purchase"})
    return got.withColumn("salience", F.round("salience", 6))


@query("SELECT user_id, event_type, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL")
def stream_latest_state(spark, sf_dir):
    """The events table as a stream, to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chronofold-stream-')}"
    name = f"latest_{uuid.uuid4().hex}"
    return latest_state.drain(latest_state.latest(stream), name, f"{base.rstrip('/')}/{name}")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.when(F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) <= 3_600_000_000, 0).otherwise(1))
    e = e.withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "k").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("k")
