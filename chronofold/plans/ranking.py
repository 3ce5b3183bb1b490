"""Orders, cuts and merges of ranked lists; document joins; entity upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import names as N
from chronofold.functions import scoring as S
from chronofold.operators import ranking as K
from chronofold.plans.registry import query
from chronofold.sources.projections import CLAIMS_EV, EPISODES, claims_ev, episodes, table

# Orders stand for ranked lists here: a customer is the query, an order a claim, a line item a turn.
_C = "c AS (SELECT o_custkey AS qid, o_orderkey AS id, round(o_totalprice / 1000000, 6) AS score, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS pos FROM orders)"


def _lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1_000_000, 6).alias("score"), F.row_number().over(w).alias("pos"))


@query(f"""WITH {_C}, t AS (SELECT qid, id, round(score * 1.1, 6) AS score FROM c WHERE id % 7 = 0), p AS (SELECT t.qid, t.id, t.score, min(c.pos) AS place FROM t LEFT JOIN c ON c.qid = t.qid AND c.score < t.score GROUP BY ALL),
  u AS (SELECT qid, id, 'claim' AS kind, pos AS key, 1 AS after, score FROM c UNION ALL SELECT qid, id, 'turn', coalesce(place, 1099511627776), 0, score FROM p)
  SELECT qid, id, kind, row_number() OVER (PARTITION BY qid ORDER BY key, after, score DESC, id) AS pos FROM u QUALIFY pos <= 12""", pos="INT")
def interleave_turns(spark, sf_dir):
    c = _lists(spark, sf_dir)
    return K.interleave(c, c.filter("id % 7 = 0").select("qid", "id", F.round(F.col("score") * 1.1, 6).alias("score")), 12)


@query(f"WITH {_C} SELECT qid, id, score FROM c QUALIFY score >= 0.8 * max(score) OVER (PARTITION BY qid) OR row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1")
def relative_floor(spark, sf_dir):
    return K.relative_floor(_lists(spark, sf_dir), 0.8).select("qid", "id", "score")


@query(f"WITH {_C} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY pos > 5, CASE WHEN pos <= 5 THEN -score END, pos) AS new_pos FROM c", new_pos="INT")
def rerank_head(spark, sf_dir):
    return K.rerank_head(_lists(spark, sf_dir).withColumn("extra", F.col("score")), 5).select("qid", "id", "new_pos")


@query(f"WITH {_C}, p AS (SELECT *, round(1 / (1 + exp(-(8 * score - 1))), 6) AS p FROM c) SELECT qid, id, p FROM p WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, pos) <= 3")
def selector_keep(spark, sf_dir):
    return K.keep_selected(_lists(spark, sf_dir).withColumn("extra", F.col("score")), 8.0, -1.0, 0.5, 3).select("qid", "id", "p")


@query(f"""WITH {_C}, e AS (SELECT qid, node, min((pos, e)) AS place FROM (SELECT qid, pos, 1 AS e, 'o' || (id % 10) AS node FROM c UNION ALL SELECT qid, pos, 0, 's' || (id % 4) FROM c) GROUP BY ALL)
  SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY place, node) AS pos FROM e QUALIFY pos <= 5""", pos="INT")
def seed_selection(spark, sf_dir):
    end = lambda mark, n: F.concat(F.lit(mark), (F.col("id") % n).cast("string"))
    return K.seeds(_lists(spark, sf_dir).select("qid", "pos", end("s", 4).alias("subject_key"), end("o", 10).alias("object_key")), 5)


@query(f"""WITH {_C}, f AS (SELECT qid, id % 50 AS id, round(sum(1.0::DOUBLE / (60 + pos)), 6) AS fused, min((id % 3, pos)) AS seen FROM c GROUP BY ALL)
  SELECT qid, id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, seen, id) AS pos FROM f QUALIFY pos <= 6""", pos="INT")
def phrasing_fusion(spark, sf_dir):
    lists = _lists(spark, sf_dir).select("qid", (F.col("id") % 3).alias("phrasing"), (F.col("id") % 50).alias("id"), F.col("pos").alias("rank"))
    return K.phrasings(lists, 6)


@query(f"WITH {EPISODES} SELECT id, lag(id) OVER (PARTITION BY role, length(content) % 40 ORDER BY ts, id) AS previous FROM episodes")
def latest_same_hash(spark, sf_dir):
    e = episodes(spark, sf_dir).withColumn("h", F.concat_ws("|", "role", (F.length("content") % 40).cast("string")))
    return K.latest_before(e, "h", "ts", "id").select("id", "previous")


@query("WITH l AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS ns, list(DISTINCT l_returnflag) AS fs FROM lineitem GROUP BY 1) SELECT l_orderkey AS id, len(ns) AS lines, len(fs) AS flags FROM l")
def ordered_union(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"), F.collect_list("l_returnflag").alias("f"))
    return l.select(F.col("l_orderkey").alias("id"), F.size(K.ordered_union("a", "a")).cast("long").alias("lines"), F.size(K.ordered_union("f", "f")).cast("long").alias("flags"))


@query("SELECT o_orderkey AS id, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 GROUP BY 1")
def documents_with_chunks(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("chunks"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(parts, F.col("id") == F.col("l_orderkey"), "left").select("id", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query("SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = c_custkey AND s_nationkey = c_nationkey)")
def cited_by_document(spark, sf_dir):
    """Rows with a path over three tables back to their own nation."""
    o, l, s = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    reach = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).select("o_custkey", "s_nationkey")
    c = table(spark, sf_dir, "customer")
    return c.join(reach, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left_semi").select(F.col("c_custkey").alias("id"))


@query(f"WITH {CLAIMS_EV} SELECT id, count(*) OVER (PARTITION BY fact_key ORDER BY recorded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS siblings FROM claims_ev")
def accumulation(spark, sf_dir):
    """How many values a slot of many already held when one more came."""
    w = W.partitionBy("fact_key").orderBy("recorded_at", "id").rowsBetween(W.unboundedPreceding, -1)
    return claims_ev(spark, sf_dir).select("id", F.count(F.lit(1)).over(w).alias("siblings"))


@query(f"WITH {CLAIMS_EV} SELECT CASE WHEN subject = 'user:7' AND valid_from < TIMESTAMP '2024-01-15 00:00:00' THEN 'user:7#before' ELSE subject END AS subject, count(*) AS n FROM claims_ev GROUP BY 1")
def entity_split(spark, sf_dir):
    """One spelling that stood for two things: what began before a boundary moves to an identity of its own."""
    before = (F.col("subject") == "user:7") & (F.col("valid_from") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return claims_ev(spark, sf_dir).groupBy(F.when(before, F.concat("subject", F.lit("#before"))).otherwise(F.col("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLAIMS_EV}, m AS (SELECT *, 'user:' || (event_id % 20) AS folded FROM claims_ev), k AS (SELECT folded || '|' || predicate || '|' || object AS v, min(recorded_at) AS first, count(*) AS n FROM m GROUP BY 1) SELECT v, first, n FROM k WHERE n > 1")
def entity_backfill(spark, sf_dir):
    """Values that become one when subjects fold to fewer identities."""
    folded = F.concat(F.lit("user:"), (F.col("event_id") % 20).cast("string"))
    return claims_ev(spark, sf_dir).groupBy(F.concat_ws("|", folded, "predicate", "object").alias("v")).agg(F.min("recorded_at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT conv_id, turn, 0.5 * greatest(0, 1 - turn / 10.0) AS score FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def episode_leg(spark, sf_dir):
    """At most three turns of a conversation, of the role a question is about, at half weight."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    c = c.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).filter("r <= 3")
    return c.select("conv_id", "turn", (0.5 * F.greatest(F.lit(0.0), 1 - F.col("turn") / 10.0)).alias("score"))


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)/', 1)) || '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/+$', ''), '\\.git$', ''), '/'), lambda p: p <> ''), '/') AS project FROM pages WHERE url LIKE '%://%/%'")
def projects(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("url").like("%://%/%")).select("page_id", N.project_of(F.col("url")).alias("project"))


@query("SELECT doc_id, CASE WHEN regexp_matches(left(text, 128), '\\p{Latin}') THEN 'latin' END AS script FROM documents")
def scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.script(F.col("text")).alias("script"))


@query(f"WITH {CLAIMS_EV} SELECT id, round(least(5.0, confidence + 0.25 * (0.1 + 0.9 * (1 - least(1.0, 0.4 / confidence)))), 6) AS base FROM claims_ev")
def reinforcement(spark, sf_dir):
    return claims_ev(spark, sf_dir).select("id", F.round(S.reinforced(F.col("confidence"), F.lit(0.4)), 6).alias("base"))
