"""Scopes, provenance, links and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import graph as G
from chronofold.operators import provenance as P
from chronofold.operators import scope as SC
from chronofold.plans.registry import query
from chronofold.sources.projections import CLAIMS_OR, EDGES, EPISODES, claims_or, edges, episodes, table


def _readers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    null = F.lit(None).cast("string")
    return c.select(F.col("c_custkey").alias("reader"), F.lit("default").alias("tenant"), F.col("c_custkey").cast("string").alias("usr"), null.alias("project"), F.lit("1-URGENT").alias("agent"), F.lit("1").alias("session"))


_CHAIN = f"""{CLAIMS_OR}, ch AS (SELECT c_custkey AS reader, c_custkey::VARCHAR AS usr, a AS agent, s AS session, r AS level_rank FROM customer, (VALUES ('1-URGENT', '1', 0), ('1-URGENT', NULL, 1), (NULL, NULL, 2)) AS v(a, s, r)),
  vis AS (SELECT ch.reader, ch.level_rank, c.* FROM claims_or c JOIN ch ON c.usr = ch.usr AND c.agent IS NOT DISTINCT FROM ch.agent AND c.session IS NOT DISTINCT FROM ch.session)"""


@query(f"WITH {_CHAIN} SELECT reader, level_rank, id FROM vis")
def scope_chain_read(spark, sf_dir):
    return SC.visible(claims_or(spark, sf_dir), _readers(spark, sf_dir)).select("reader", "level_rank", "id")


@query(f"WITH {_CHAIN} SELECT reader, level_rank, id FROM vis QUALIFY level_rank = min(level_rank) OVER (PARTITION BY reader, fact_key)")
def scope_shadowing(spark, sf_dir):
    return SC.shadow(SC.visible(claims_or(spark, sf_dir), _readers(spark, sf_dir))).select("reader", "level_rank", "id")


@query(f"WITH {CLAIMS_OR} SELECT a.session, count(*) AS seen FROM claims_or a JOIN claims_or b ON a.usr = b.usr AND a.agent IS NOT DISTINCT FROM b.agent AND a.session = b.session AND a.id <> b.id GROUP BY a.session")
def sibling_isolation(spark, sf_dir):
    """Pairs that share a session see each other; none is seen across sessions."""
    per = claims_or(spark, sf_dir).filter("session IS NOT NULL").groupBy("usr", "agent", "session").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("session").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("seen")).filter("seen > 0")


@query(f"WITH {CLAIMS_OR} SELECT DISTINCT fact_key FROM claims_or WHERE agent IS NULL AND session IS NULL")
def occupied_slots(spark, sf_dir):
    return claims_or(spark, sf_dir).filter("agent IS NULL AND session IS NULL").select("fact_key").distinct()


@query(f"WITH {CLAIMS_OR} SELECT coalesce(agent, '*') AS agent, coalesce(session, '*') AS session, count(*) AS n, round(sum(amount), 2) AS amount FROM claims_or GROUP BY 1, 2")
def counts_by_scope(spark, sf_dir):
    c = claims_or(spark, sf_dir)
    return c.groupBy(F.coalesce("agent", F.lit("*")).alias("agent"), F.coalesce("session", F.lit("*")).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def _cited(spark, sf_dir):
    """Orders as claims that cite their line items."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    src = F.transform("s", lambda x: F.concat_ws("_", F.lit("part"), x["l_partkey"].cast("string")))
    return l.select(F.col("l_orderkey").alias("id"), F.array_distinct(src).alias("sources"))


_CITES = """c AS (SELECT l_orderkey AS claim, 'part_' || l_partkey AS episode, l_partkey AS part, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)"""


@query(f"WITH {_CITES} SELECT claim, episode, row_number() OVER (PARTITION BY claim ORDER BY line, part) - 1 AS pos, p_brand FROM c JOIN part ON 'part_' || p_partkey = episode", pos="INT")
def why_sources(spark, sf_dir):
    eps = table(spark, sf_dir, "part").select(F.concat_ws("_", F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), "p_brand")
    return P.why(_cited(spark, sf_dir), eps).select("claim", "episode", "pos", "p_brand")


@query(f"WITH {_CITES} SELECT episode, count(DISTINCT claim) AS claims FROM c GROUP BY episode")
def produced_by_turn(spark, sf_dir):
    return P.produced(_cited(spark, sf_dir)).groupBy("episode").agg(F.count(F.lit(1)).alias("claims"))


@query("""WITH c AS (SELECT DISTINCT 'part_' || l_partkey AS e FROM lineitem WHERE l_returnflag = 'R') SELECT 'part_' || p_partkey AS id FROM part WHERE 'part_' || p_partkey NOT IN (SELECT e FROM c)""")
def orphan_turns(spark, sf_dir):
    """Sources that nothing (of the returned lines) cites any more."""
    eps = table(spark, sf_dir, "part").select(F.concat_ws("_", F.lit("part"), F.col("p_partkey").cast("string")).alias("id"))
    cites = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.array(F.concat_ws("_", F.lit("part"), F.col("l_partkey").cast("string"))).alias("sources"))
    return P.orphans(eps, cites)


_LINKS = "links AS (SELECT DISTINCT l_partkey AS from_id, l_suppkey AS to_id, CASE WHEN l_quantity > 25 THEN 'extends' ELSE 'derives' END AS relation FROM lineitem)"


@query(f"WITH {_LINKS} SELECT from_id AS id, to_id AS other, relation, true AS outgoing FROM links UNION ALL SELECT to_id, from_id, relation, false FROM links WHERE from_id <> to_id")
def links_of(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    links = l.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.when(F.col("l_quantity") > 25, "extends").otherwise("derives").alias("relation")).distinct()
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).unionAll(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))).distinct()
    return P.links_of(links, ids)


@query(f"WITH {_LINKS}, old AS (SELECT * FROM links WHERE relation = 'derives'), new AS (SELECT DISTINCT from_id, to_id FROM links WHERE relation = 'extends') SELECT from_id, to_id FROM new ANTI JOIN old USING (from_id, to_id)")
def insert_links(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), (F.col("l_quantity") > 25).alias("new"))
    return P.insert_ignore(l.filter("NOT new"), l.filter("new").select("from_id", "to_id"), ["from_id", "to_id"])


@query(f"WITH {EPISODES} SELECT id, conv_id, turn, ts FROM episodes WHERE ts <= TIMESTAMP '2024-01-04 00:00:00'")
def episodes_happened(spark, sf_dir):
    from chronofold.functions import clocks as C

    return episodes(spark, sf_dir).filter(C.happened_expr("2024-01-05 00:00:00", "2024-01-04 00:00:00")).select("id", "conv_id", "turn", "ts")


@query(f"WITH {EPISODES} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03 12:02:00')), hash, id) AS pos FROM episodes QUALIFY pos <= 2", pos="INT")
def episodes_near(spark, sf_dir):
    from pyspark.sql import Window as W

    e = episodes(spark, sf_dir)
    away = F.abs(F.timestamp_diff("MICROSECOND", F.lit("2024-01-03 12:02:00").cast("timestamp_ntz"), F.col("ts")))
    return e.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy(away, "hash", "id"))).filter("pos <= 2").select("conv_id", "id", "pos")


@query(f"WITH {EDGES}, s AS (SELECT DISTINCT src FROM edges) SELECT count_if(tgt IN (SELECT src FROM s)) AS hit, count(*) AS n, round(count_if(tgt IN (SELECT src FROM s)) / count(*), 6) AS rate FROM edges", hit="BIGINT")
def connectivity_rate(spark, sf_dir):
    return G.join_rate(edges(spark, sf_dir))


_STEPS = f"{EDGES}, st AS (SELECT src AS node, tgt AS other, predicate, false AS backward, confidence AS strength FROM edges UNION ALL SELECT tgt, src, predicate, true, confidence FROM edges)"


@query(f"WITH {_STEPS} SELECT DISTINCT node AS seed, other AS node, 1 AS hops FROM st WHERE node LIKE 'nation:%'")
def neighborhood_1hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("seed"))
    return G.reachable(edges(spark, sf_dir), seeds, 1)


@query(f"""WITH {_STEPS}, h1 AS (SELECT DISTINCT node AS seed, other AS node FROM st WHERE node LIKE 'region:%'), h2 AS (SELECT DISTINCT seed, st.other AS node FROM h1 JOIN st ON st.node = h1.node WHERE st.other <> seed)
  SELECT seed, node, 1 AS hops FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 ANTI JOIN h1 USING (seed, node)""")
def neighborhood_2hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    return G.reachable(edges(spark, sf_dir), seeds, 2)


@query(f"""WITH {_STEPS}, a AS (SELECT node AS s, other AS m, strength AS x FROM st WHERE node LIKE 'supplier:%'),
  p AS (SELECT s, [s, m, st.other] AS nodes, x * strength * 0.75 AS score FROM a JOIN st ON st.node = m WHERE st.other LIKE 'region:%')
  SELECT s AS source, nodes[3] AS target, 1 AS pos, array_to_string(nodes, '>') AS path, round(score, 6) AS score FROM p""")
def paths_between(spark, sf_dir):
    """From every supplier to its region."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("target"))
    small = edges(spark, sf_dir).filter("predicate <> 'placed' AND NOT src LIKE 'customer:%'")
    return G.paths_between(small, pairs, 2)


@query(f"""WITH {_STEPS}, a AS (SELECT node AS s, other AS n, strength AS x FROM st WHERE node LIKE 'region:%'), b AS (SELECT s, st.other AS n, x * strength * 0.75 AS x FROM a JOIN st ON st.node = a.n WHERE st.other <> s),
  u AS (SELECT s, n, x FROM a UNION ALL SELECT s, n, x FROM b) SELECT s AS qid, n AS node, round(max(x), 6) AS score FROM u GROUP BY ALL""")
def spread_scores(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    return G.spread(edges(spark, sf_dir).filter("predicate <> 'placed'").unionAll(edges(spark, sf_dir).filter("predicate = 'placed'")), seeds.withColumn("qid", F.col("seed")), 2)


@query(None)
def walk_beam(spark, sf_dir):
    """Beam walk of two hops from regions, with diversity by relation."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    got = G.walk(edges(spark, sf_dir), seeds, 2)
    return got.select("seed", "hops", G.render(F.col("nodes"), F.col("predicates"), F.col("directions")).alias("path"), F.round("score", 6).alias("score"))
