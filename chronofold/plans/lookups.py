"""Lookups, merged lists, routing and the small derived columns of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import claims as K
from chronofold.functions import clocks as C
from chronofold.functions import language as L
from chronofold.functions import routing as Q
from chronofold.operators import graph as G
from chronofold.operators import lookups as U
from chronofold.plans import reading  # noqa: F401  (its SQL of intents)
from chronofold.plans.registry import ORACLES, query
from chronofold.plans.temporal import AT, _holds, _known
from chronofold.sources.projections import CLAIMS_EV, EDGES, EPISODES, claims_ev, edges, episodes, table

_STATE = "CASE WHEN invalidated_at IS NOT NULL THEN 'retired' WHEN valid_to IS NOT NULL THEN 'ended' ELSE 'live' END"


def _pick(column: str, values: list) -> F.Column:
    """One of the values by a number's remainder."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.expr(f"cast({column} % {len(values)} as int) + 1"))


def _sql_pick(column: str, values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({column} % {len(values)})::INT + 1]"


@query(f"WITH {CLAIMS_EV} SELECT id, fact_key, object, {_STATE} AS state FROM claims_ev WHERE {_STATE} IN ('live', 'ended')")
def walk_stored(spark, sf_dir):
    return U.stored_in(claims_ev(spark, sf_dir), ["live", "ended"]).select("id", "fact_key", "object", C.stored_state().alias("state"))


@query(f"WITH {CLAIMS_EV} SELECT id, subject, predicate, object FROM claims_ev WHERE id IN (SELECT 'ev_' || p_partkey FROM part)")
def claims_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("ev_"), F.col("p_partkey").cast("string")).alias("id"))
    return U.by_id(claims_ev(spark, sf_dir), ids).select("id", "subject", "predicate", "object")


@query(f"WITH {CLAIMS_EV} SELECT fact_key, count(*) AS n FROM claims_ev WHERE {_known(AT)} AND {_holds(AT)} GROUP BY fact_key")
def competing_claims(spark, sf_dir):
    return U.competing(claims_ev(spark, sf_dir), AT, AT)


def _scored(spark, sf_dir):
    return claims_ev(spark, sf_dir).select(F.col("usr").alias("qid"), "id", F.col("predicate").alias("type"), F.round("value", 6).alias("score"), "event_id")


@query(f"""WITH {CLAIMS_EV} SELECT usr AS qid, id, predicate AS type, round(value, 6) AS score, row_number() OVER (PARTITION BY usr ORDER BY round(value, 6) DESC, id) AS pos
  FROM claims_ev WHERE predicate IN ('purchase', 'signup') AND round(value, 6) >= 5 QUALIFY pos <= 3""", pos="INT")
def typed_topk(spark, sf_dir):
    """Types and floor before the cut."""
    return U.best_of(_scored(spark, sf_dir), 3, ["purchase", "signup"], 5.0).drop("event_id")


@query(f"""WITH {CLAIMS_EV}, h AS (SELECT usr AS qid, id, round(value, 6) AS score FROM claims_ev WHERE event_id % 3 > 0
  UNION ALL SELECT usr, id, round(value, 6) * 0.75 FROM claims_ev WHERE event_id % 2 = 0) SELECT qid, id, round(max(score), 6) AS score FROM h GROUP BY qid, id""")
def merged_hits(spark, sf_dir):
    """Hits of two legs, one of them damped, that overlap in a third of their rows."""
    s = _scored(spark, sf_dir)
    both = U.merge_hits(s.filter("event_id % 3 > 0"), s.filter("event_id % 2 = 0").withColumn("score", F.col("score") * 0.75))
    return both.withColumn("score", F.round("score", 6))


_KINDS = [None, "entity", "text", "number"]


@query(f"""WITH {CLAIMS_EV} SELECT id FROM claims_ev WHERE event_id % 13 <> 0 AND subject <> '' AND object <> '' AND subject <> object
  AND coalesce({_sql_pick('event_id', _KINDS)}, 'entity') = 'entity'""")
def walkable_claims(spark, sf_dir):
    rows = claims_ev(spark, sf_dir).select("id", F.col("subject").alias("subject_key"), F.col("object").alias("object_key"), _pick("event_id", _KINDS).alias("object_kind"), F.when(F.col("event_id") % 13 == 0, -1).otherwise(1).alias("polarity"))
    return rows.filter(K.walkable()).select("id")


_HOW, _BY = ["user", "inferred", "user"], ["", "api", "rules", None, "model"]


@query(f"WITH {CLAIMS_EV} SELECT id, NOT ({_sql_pick('event_id', _HOW)} = 'user' AND coalesce({_sql_pick('event_id', _BY)}, '') IN ('', 'api')) AS derived FROM claims_ev")
def derived_claims(spark, sf_dir):
    return claims_ev(spark, sf_dir).select("id", K.derived(_pick("event_id", _HOW), _pick("event_id", _BY)).alias("derived"))


_TYPES, _ABOUT = ["procedural", "semantic", "episodic", "procedural"], ["user", "project:a", "service", "userland", "project"]


@query(f"""WITH {CLAIMS_EV}, t AS (SELECT id, predicate, {_sql_pick('event_id', _TYPES)} AS was, {_sql_pick('event_id', _ABOUT)} AS about FROM claims_ev)
  SELECT id, about, CASE WHEN was = 'procedural' AND about NOT IN ('user', 'project:a') THEN 'semantic' ELSE was END AS memory_type FROM t""")
def filed_types(spark, sf_dir):
    about = _pick("event_id", _ABOUT)
    return claims_ev(spark, sf_dir).select("id", about.alias("about"), K.filed(_pick("event_id", _TYPES), about, F.col("predicate")).alias("memory_type"))


_PRECISION = ["instant", "day", "week", "month", "season", "year", None]
_UPPER = """CASE p WHEN 'day' THEN valid_from + INTERVAL 1 DAY WHEN 'week' THEN valid_from + INTERVAL 7 DAY
  WHEN 'month' THEN date_trunc('month', valid_from) + INTERVAL 1 MONTH + (valid_from - date_trunc('day', valid_from))
  WHEN 'season' THEN date_trunc('month', valid_from) + INTERVAL 3 MONTH + (valid_from - date_trunc('day', valid_from))
  WHEN 'year' THEN date_trunc('year', valid_from) + INTERVAL 1 YEAR + (valid_from - date_trunc('day', valid_from)) ELSE valid_from END"""


@query(f"""WITH {CLAIMS_EV}, t AS (SELECT id, valid_from, valid_to, {_sql_pick('event_id', _PRECISION)} AS p FROM claims_ev)
  SELECT id, {_UPPER} AS denotes_until, valid_to >= {_UPPER} AND valid_to > valid_from AS surely_after FROM t""")
def precedence(spark, sf_dir):
    """What span each start denotes, and whether the slot's next claim begins surely after it."""
    rows = claims_ev(spark, sf_dir).select("id", "valid_from", "valid_to", _pick("event_id", _PRECISION).alias("p"))
    return rows.select("id", K.upper_bound(F.col("valid_from"), F.col("p")).alias("denotes_until"), K.is_after(F.col("valid_to"), F.col("valid_from"), F.col("p")).alias("surely_after"))


@query(f"""SELECT conv_id, turn, intent, 1.0::DOUBLE AS vector, 1.0::DOUBLE AS lexical, CASE WHEN intent IN ('lookup', 'temporal') THEN 0 ELSE 0.6 END::DOUBLE AS graph,
  CASE WHEN intent IN ('lookup', 'relational') THEN 0 ELSE 0.4 END::DOUBLE AS temporal FROM ({ORACLES['intents']})""")
def leg_weights(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", L.intent(F.col("text")).alias("intent"))
    given = {"vector": 1.0, "lexical": 1.0, "graph": 0.6, "temporal": 0.4}
    return asked.select("*", *(Q.leg_weight(F.col("intent"), leg, w).alias(leg) for leg, w in given.items()))


@query(f"""WITH {EDGES}, s AS (SELECT src AS node, tgt AS other, src || '|' || predicate || '|' || tgt AS k FROM edges UNION ALL SELECT tgt, src, src || '|' || predicate || '|' || tgt FROM edges)
  SELECT least(node, other) || chr(31) || k AS path, count(*) AS readings FROM s WHERE node LIKE 'nation:%' OR node LIKE 'region:%' GROUP BY 1""")
def paths_undirected(spark, sf_dir):
    """First hops from nations and regions; an edge between two seeds is read from both ends and is one path all the same."""
    e = edges(spark, sf_dir)
    seeds = G.both_ways(e).select(F.col("node").alias("seed")).filter("seed LIKE 'nation:%' OR seed LIKE 'region:%'").distinct()
    paths = G.walk(e, seeds, 1, beam=None).withColumn("keys", G.edge_keys(F.col("nodes"), F.col("predicates"), F.col("directions")))
    return paths.groupBy(G.undirected(F.col("nodes"), F.col("keys")).alias("path")).agg(F.count(F.lit(1)).alias("readings"))


@query(f"WITH {EPISODES} SELECT c.conv_id AS document, c.turn AS position, e.id, e.content FROM conversations c JOIN episodes e ON e.id = 'ep_' || c.conv_id || '_' || c.turn WHERE c.role = 'assistant'")
def chunk_hydration(spark, sf_dir):
    turns = episodes(spark, sf_dir)
    return U.chunk_turns(turns.filter("role = 'assistant'").select(F.col("conv_id").alias("document"), F.col("turn").alias("position"), "id"), turns)


@query(f"""WITH {CLAIMS_EV}, m AS (SELECT id, CASE WHEN event_id % 17 = 0 THEN '' ELSE object END AS key FROM claims_ev),
  k AS (SELECT DISTINCT p_size::VARCHAR AS key FROM part), a AS (SELECT DISTINCT n_nationkey::VARCHAR AS key, 'region ' || n_regionkey AS target FROM nation)
  SELECT id, m.key, CASE WHEN m.key = '' THEN 'empty' WHEN target IS NOT NULL THEN 'alias' WHEN k.key IS NOT NULL THEN 'known' ELSE 'novel' END AS resolution,
    CASE WHEN m.key = '' THEN '' ELSE coalesce(target, m.key) END AS entity FROM m LEFT JOIN a ON a.key = m.key LEFT JOIN k ON k.key = m.key""")
def entity_resolution(spark, sf_dir):
    mentions = claims_ev(spark, sf_dir).select("id", F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("object")).alias("key"))
    known = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("key")).distinct()
    aliases = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("target")).distinct()
    return U.resolve_entities(mentions, known, aliases)


@query("""WITH s AS (SELECT DISTINCT p_type AS name FROM part), p AS (SELECT DISTINCT p_name AS key FROM part),
  sw AS (SELECT DISTINCT name AS qid, unnest(string_split(lower(name), ' ')) AS word FROM s), pw AS (SELECT DISTINCT key, unnest(string_split(lower(key), ' ')) AS word FROM p)
  SELECT qid, key, count(*) AS shared, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, key) AS pos FROM sw JOIN pw USING (word) WHERE word <> '' GROUP BY qid, key QUALIFY pos <= 16""", pos="INT")
def name_shortlist(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return U.shortlist(part.select(F.col("p_type").alias("qid"), F.col("p_type").alias("name")).distinct(), part.select(F.col("p_name").alias("key")).distinct(), 16)


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, day(o_orderdate) || strftime(o_orderdate, ' %B %Y') AS spoken FROM orders")
def rendered_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), K.iso_utc(at).alias("iso"), K.spoken_day(at).alias("spoken"))


_SPELLED = [" Mins", "h", "KM", "furlongs", "", "Dollars", None, "kilometre", "$"]


@query(f"SELECT p_partkey AS id, {_sql_pick('p_partkey', ['minute', 'hour', 'kilometer', 'furlongs', None, 'usd', None, 'kilometer', 'usd'])} AS unit FROM part")
def folded_units(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), K.canonical_unit(_pick("p_partkey", _SPELLED)).alias("unit"))


@query(f"""WITH {CLAIMS_EV} SELECT id, tenant || chr(31) || usr || chr(31) || object AS entity, tenant || chr(31) || usr AS owner, object AS name, tenant FROM claims_ev""")
def entity_ids(spark, sf_dir):
    rows = claims_ev(spark, sf_dir).select("id", K.entity_id(F.concat_ws(K.OWNER_SEP, "tenant", "usr"), F.col("object")).alias("entity"))
    owner = K.entity_owner(F.col("entity"))
    return rows.select("id", "entity", owner.alias("owner"), K.entity_name(F.col("entity")).alias("name"), K.tenant_of(owner).alias("tenant"))


@query(f"""WITH {CLAIMS_EV}, s AS (SELECT fact_key, min(valid_from) - INTERVAL 5 DAY AS a, max(valid_from) + INTERVAL 5 DAY AS b FROM claims_ev GROUP BY fact_key),
  c AS (SELECT fact_key, greatest(valid_from, a) AS since, least(valid_to, b) AS until FROM claims_ev JOIN s USING (fact_key) WHERE valid_to IS NOT NULL AND event_id % 3 > 0),
  u AS (SELECT * FROM c WHERE since < until UNION ALL SELECT fact_key, a, a FROM s UNION ALL SELECT fact_key, b, b FROM s),
  g AS (SELECT fact_key, since, max(until) OVER (PARTITION BY fact_key ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM u)
  SELECT fact_key, upto AS gap_from, since AS gap_to FROM g WHERE since > upto""")
def uncovered_periods(spark, sf_dir):
    """What of a slot's whole time none of two thirds of its claims covers: the periods that a restatement would still have to store."""
    c = claims_ev(spark, sf_dir)
    spans = c.groupBy("fact_key").agg((F.min("valid_from") - F.make_dt_interval(F.lit(5))).alias("since"), (F.max("valid_from") + F.make_dt_interval(F.lit(5))).alias("until"))
    cover = c.filter("valid_to IS NOT NULL AND event_id % 3 > 0").select("fact_key", F.col("valid_from").alias("since"), F.col("valid_to").alias("until"))
    return U.uncovered(spans, cover, "fact_key")


@query("""WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
  SELECT id, list_transform(v, lambda x: round(x / norm, 6)) AS unit FROM n WHERE norm > 0""")
def unit_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), K.unit_vector(F.col("embedding")).alias("unit"))
    return rows.filter("unit IS NOT NULL").withColumn("unit", F.transform("unit", lambda x: K.round_scaled(x, 6)))
