"""Reading turns and answering people: rule facts, intents, embeddings, recall blocks, profiles, near-duplicate merging, rank statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.functions import language as L
from chronofold.functions.text import gate_reason
from chronofold.operators import retrieval as R
from chronofold.operators.merging import merge_near
from chronofold.plans.registry import query
from chronofold.plans.upkeep import GATE_SQL
from chronofold.sources.projections import CLAIMS_EV, claims_ev, episodes, table
from chronofold.sources.vocabulary import Vocabulary

NOW, AT = "2024-02-20 00:00:00", "2024-01-15 00:00:00"
_LIVE = f"recorded_at <= TIMESTAMP '{NOW}' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{NOW}') AND valid_from <= TIMESTAMP '{NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{NOW}')"


@query("""WITH o AS (SELECT 'or_' || o_orderkey AS id, n_name AS object, o_orderkey % 5 + 2 AS n, o_orderstatus AS s, o_orderdate::TIMESTAMP AS ts FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
  SELECT id, 'lives_in' AS predicate, object, CASE WHEN s = 'P' THEN -1 ELSE 1 END AS polarity, CASE s WHEN 'F' THEN 'last month' WHEN 'O' THEN n || ' days ago' END AS said_when,
    CASE s WHEN 'F' THEN date_trunc('month', ts) - INTERVAL 1 MONTH WHEN 'O' THEN date_trunc('day', ts) - to_days(n::INT) ELSE ts END::TIMESTAMP AS valid_from,
    CASE s WHEN 'F' THEN 'month' WHEN 'O' THEN 'day' ELSE 'instant' END AS precision FROM o""", polarity="INT")
def fast_facts(spark, sf_dir):
    """Facts stated in turns: those of the conversations (which state none of these plainly) and one for each order, in which its customer says
    when they moved to their nation, or that they live there no more, after a question about another place that states nothing."""
    home = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, sf_dir, "orders").join(home, F.col("o_custkey") == F.col("c_custkey"))
    ago = F.concat((F.col("o_orderkey") % 5 + 2).cast("string"), F.lit(" days ago."))
    said = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("I no longer live in "), "n_name", F.lit("."))).otherwise(F.concat(F.lit("I moved to "), "n_name", F.lit(" "), F.when(F.col("o_orderstatus") == "F", "last month.").otherwise(ago)))
    stated = o.select(F.concat(F.lit("or_"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Do I live in Lisbon? "), said).alias("content"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return L.extract_facts(episodes(spark, sf_dir).select("id", "content", "ts").unionByName(stated))


_ARR = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


@query(f"""WITH w AS (SELECT conv_id, turn, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM conversations WHERE text IS NOT NULL)
  SELECT conv_id, turn, CASE WHEN list_has_any(ws, {_ARR(L.TEMPORAL)}) OR len(list_filter(ws, lambda x: regexp_full_match(x, '(19|20|21)[0-9][0-9]'))) > 0 THEN 'temporal'
    WHEN list_has_any(ws, {_ARR(L.RELATIONAL)}) OR len(regexp_extract_all(t, '\\p{{L}}[''’]s\\b')) > 1 OR regexp_matches(t, '\\bbetween\\b.+\\band\\b') THEN 'relational'
    WHEN list_has_any(ws, {_ARR(L.LOOKUP)}) THEN 'lookup' ELSE 'open' END AS intent FROM w""")
def intents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", L.intent(F.col("text")).alias("intent"))


@query(None)
def hash_embeddings(spark, sf_dir):
    return L.embed(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(None)
def embedding_search(spark, sf_dir):
    """Documents nearest to benchmark questions by hashed embeddings."""
    docs = L.embed(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = L.embed(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "qid")
    return R.vector_topk(docs, asked, 5)


@query(None)
def window_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    head = R.bm25(docs, asked, 10).select("qid", "id")
    pairs = head.join(docs, "id").join(asked.withColumnRenamed("text", "question"), "qid")
    return L.rerank(pairs.select("qid", "id", "question", "text"))


@query(f"""WITH {CLAIMS_EV}, r AS (SELECT usr, id, 'user:' || usr || ' ' || replace(predicate, '_', ' ') || ' ' || object AS line, row_number() OVER (PARTITION BY usr ORDER BY confidence DESC, recorded_at DESC, id) AS pos FROM claims_ev WHERE {_LIVE}),
  b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY usr ORDER BY pos) AS used FROM r) SELECT usr, id, pos, line FROM b WHERE used <= 400""", pos="INT")
def recall_budget(spark, sf_dir):
    """Lines for a prompt, best first, as far as 400 characters (100 tokens of four) go."""
    c = claims_ev(spark, sf_dir).filter(C.live_expr(NOW, NOW))
    w = W.partitionBy("usr").orderBy(F.desc("confidence"), F.desc("recorded_at"), "id")
    c = c.select("usr", "id", L.render(F.col("subject"), F.col("predicate"), F.col("object"), F.col("polarity")).alias("line"), F.row_number().over(w).alias("pos"))
    used = F.sum(F.length("line") + 1).over(W.partitionBy("usr").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return c.withColumn("used", used).filter("used <= 400").select("usr", "id", "pos", "line")


@query(f"""WITH {CLAIMS_EV}, l AS (SELECT * FROM claims_ev WHERE {_LIVE}), k AS (SELECT subject, CASE WHEN valid_from > TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'recent' ELSE 'standing' END AS section, id, confidence, recorded_at FROM l)
  SELECT subject, section, id FROM k QUALIFY row_number() OVER (PARTITION BY subject, section ORDER BY confidence DESC, recorded_at DESC, id) <= 2""")
def profile_sections(spark, sf_dir):
    live = claims_ev(spark, sf_dir).filter(C.live_expr(NOW, NOW))
    recent = F.col("valid_from") > C.instant(NOW) - F.expr("INTERVAL 30 DAYS")
    live = live.withColumn("section", F.when(recent, "recent").otherwise("standing"))
    w = W.partitionBy("subject", "section").orderBy(F.desc("confidence"), F.desc("recorded_at"), "id")
    return live.withColumn("pos", F.row_number().over(w)).filter("pos <= 2").select("subject", "section", "id")


@query(f"SELECT 'ep_' || conv_id || '_' || turn AS id FROM ({GATE_SQL}) WHERE reason = 'has_declarative' AND conv_id % 3 <> 0")
def pending_extraction(spark, sf_dir):
    """Turns that pass the gate and that no claim cites (here: those of every third conversation are cited)."""
    e = episodes(spark, sf_dir)
    cited = e.filter("conv_id % 3 = 0").select("id")
    return e.filter(gate_reason(F.col("content"), F.col("role")) == "has_declarative").join(cited, "id", "left_anti").select("id")


@query(None)
def near_dup_merge(spark, sf_dir):
    """Near-identical values of a slot, folded into the one that survives."""
    c = claims_ev(spark, sf_dir).withColumn("obs_count", (1 + F.col("event_id") % 3).cast("int"))
    return merge_near(c.select("fact_key", "id", F.concat_ws(" ", "predicate", "object", F.lit("value of the metric")).alias("text"), "obs_count", "recorded_at"), 0.97)


@query("""WITH r AS (SELECT lang, n_chars::DOUBLE AS x, length(text)::DOUBLE AS y FROM documents), k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS b FROM r) SELECT lang, round(corr(a, b), 6) AS rho FROM k GROUP BY lang""")
def rank_correlation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("x"), F.length("text").alias("y"))
    tied = lambda c: F.rank().over(W.partitionBy("lang").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("lang", c)) - 1) / 2.0
    return d.withColumn("a", tied("x")).withColumn("b", tied("y")).groupBy("lang").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query(f"WITH {CLAIMS_EV} SELECT predicate, 'many' AS cardinality, 730 AS half_life, count(*) AS n FROM claims_ev GROUP BY predicate")
def predicate_stats(spark, sf_dir):
    c = Vocabulary().describe(claims_ev(spark, sf_dir))
    return c.groupBy("predicate", "cardinality", "half_life").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLAIMS_EV}, q AS (SELECT unnest(['7', '11']) AS term) SELECT DISTINCT id FROM claims_ev JOIN q ON usr = term WHERE {_LIVE}""")
def anchored_search(spark, sf_dir):
    """Live claims whose subject a question names in full."""
    from chronofold.functions.filters import all_named

    asked = F.array(F.lit("user"), F.lit("7"), F.lit("11"))
    live = claims_ev(spark, sf_dir).filter(C.live_expr(NOW, NOW))
    return live.filter(all_named(F.split("subject", ":"), asked)).select("id")
