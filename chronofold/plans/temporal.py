"""Point-in-time, window, history, delta and lifecycle reads over the event claims."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.operators import temporal as T
from chronofold.plans.registry import query
from chronofold.sources.projections import CLAIMS_EV, claims_ev

AT, LATER, NOW = "2024-01-15 00:00:00", "2024-01-22 00:00:00", "2024-02-20 00:00:00"
_ROW = "id, subject, predicate, object, valid_from, valid_to, recorded_at, confidence"
_COLS = _ROW.split(", ")


def _sql(where: str, cols: str = _ROW) -> str:
    return f"WITH {CLAIMS_EV} SELECT {cols} FROM claims_ev WHERE {where}"


def _known(t: str) -> str:
    return f"recorded_at <= TIMESTAMP '{t}' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '{t}')"


def _holds(t: str, start: str | None = None) -> str:
    return f"valid_from <= TIMESTAMP '{t}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{start or t}')"


_FRESH = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


@query(_sql(f"{_known(AT)} AND {_holds(AT)} AND {_FRESH}"))
def states_asof(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE], AT, AT, NOW).select(*_COLS)


@query(_sql(f"{_known(NOW)} AND {_holds(NOW)} AND {_FRESH}"))
def get_all_live(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE], NOW, NOW, NOW).select(*_COLS)


@query(_sql(f"{_known(AT)} AND valid_to IS NOT NULL AND valid_to <= TIMESTAMP '{AT}' AND {_FRESH}"))
def states_ended(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.ENDED], AT, AT, NOW).select(*_COLS)


@query(_sql(f"recorded_at <= TIMESTAMP '{AT}' AND invalidated_at <= TIMESTAMP '{AT}' AND {_FRESH}"))
def states_retired(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.RETIRED], AT, AT, NOW).select(*_COLS)


@query(_sql(f"{_known(AT)} AND valid_from <= TIMESTAMP '{AT}' AND {_FRESH}"))
def states_live_ended(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE, C.ENDED], AT, AT, NOW).select(*_COLS)


@query(_sql(f"recorded_at <= TIMESTAMP '{AT}' AND (invalidated_at <= TIMESTAMP '{AT}' OR ({_holds(AT)})) AND {_FRESH}"))
def states_live_retired(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE, C.RETIRED], AT, AT, NOW).select(*_COLS)


@query(_sql(f"recorded_at <= TIMESTAMP '{AT}' AND {_FRESH}"))
def states_audit(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), C.STATES, AT, AT, NOW).select(*_COLS)


@query(_sql(f"{_known(NOW)} AND {_holds(LATER, AT)} AND {_FRESH}"))
def valid_during(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE], NOW, LATER, NOW, start=AT).select(*_COLS)


@query(_sql(f"{_known(LATER)} AND {_holds(AT)} AND recorded_at > TIMESTAMP '{AT}' AND {_FRESH}"))
def delayed_knowledge(spark, sf_dir):
    """What held at one instant but was only told later."""
    later = T.read(claims_ev(spark, sf_dir), [C.LIVE], LATER, AT, NOW)
    return later.filter(F.col("recorded_at") > C.instant(AT)).select(*_COLS)


@query(_sql(f"{_known(AT)} AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')"))
def unended_claims(spark, sf_dir):
    return claims_ev(spark, sf_dir).filter(C.unended_expr(AT, AT)).select(*_COLS)


@query(f"""WITH {CLAIMS_EV} SELECT CASE WHEN invalidated_at IS NOT NULL THEN 'retired' WHEN valid_to IS NOT NULL THEN 'ended' ELSE 'live' END AS state,
  count(*) AS n, count(DISTINCT subject) AS subjects FROM claims_ev GROUP BY 1""")
def stats_by_state(spark, sf_dir):
    return claims_ev(spark, sf_dir).groupBy(C.stored_state().alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"))


@query(_sql(f"{_known(AT)} AND {_holds(AT)} AND {_FRESH}", "count(*) AS n"))
def count_visible(spark, sf_dir):
    return T.read(claims_ev(spark, sf_dir), [C.LIVE], AT, AT, NOW).agg(F.count(F.lit(1)).alias("n"))


@query(_sql(f"expires_at <= TIMESTAMP '{NOW}'", "id, expires_at"))
def expired_claims(spark, sf_dir):
    return claims_ev(spark, sf_dir).filter(F.col("expires_at") <= C.instant(NOW)).select("id", "expires_at")


@query(f"""WITH {CLAIMS_EV}, t AS (SELECT unnest([recorded_at, invalidated_at, valid_from, valid_to, expires_at]) AS ch, subject FROM claims_ev)
  SELECT subject, min(ch) AS next_change FROM t WHERE ch > TIMESTAMP '{AT}' GROUP BY subject""")
def next_state_change(spark, sf_dir):
    rows = claims_ev(spark, sf_dir).select("subject", C.next_change(AT).alias("at"))
    return rows.groupBy("subject").agg(F.min("at").alias("next_change")).filter("next_change IS NOT NULL")


@query(f"""WITH {CLAIMS_EV} SELECT id, fact_key, object, valid_from, valid_to, recorded_at, row_number() OVER (PARTITION BY fact_key ORDER BY recorded_at, id) AS pos
  FROM claims_ev WHERE recorded_at <= TIMESTAMP '{LATER}' AND {_FRESH}""", pos="INT")
def slot_history(spark, sf_dir):
    return T.history(claims_ev(spark, sf_dir), LATER, NOW).select("id", "fact_key", "object", "valid_from", "valid_to", "recorded_at", "pos")


@query(f"""WITH {CLAIMS_EV}, s AS (SELECT *, lead(id) OVER (PARTITION BY fact_key ORDER BY valid_from, event_id) AS successor FROM claims_ev)
  SELECT a.id, a.fact_key, a.object FROM s a LEFT JOIN s b ON b.id = a.successor
  WHERE a.recorded_at <= TIMESTAMP '{AT}' AND a.valid_from <= TIMESTAMP '{AT}' AND (a.invalidated_at IS NULL OR a.invalidated_at > TIMESTAMP '{AT}')
    AND (a.valid_to IS NULL OR a.valid_to > TIMESTAMP '{AT}' OR (b.id IS NOT NULL AND b.recorded_at > TIMESTAMP '{AT}'))""")
def stated_at(spark, sf_dir):
    """What one would have said at an instant: open rows, and rows whose successor had not been told yet."""
    w = W.partitionBy("fact_key").orderBy("valid_from", "event_id")
    rows = claims_ev(spark, sf_dir).withColumn("successor", F.lead("id").over(w)).withColumn("successor_recorded", F.lead("recorded_at").over(w))
    return rows.filter(T.stated_expr(AT)).select("id", "fact_key", "object")


_DELTA = f"""WITH {CLAIMS_EV}, a AS (SELECT id, subject FROM claims_ev WHERE {_known(AT)} AND {_holds(AT)} AND {_FRESH}),
  b AS (SELECT id, subject FROM claims_ev WHERE {_known(LATER)} AND {_holds(LATER)} AND {_FRESH}) SELECT {{}}"""


@query(_DELTA.format("* FROM b ANTI JOIN a USING (id)"))
def since_added(spark, sf_dir):
    return T.delta(claims_ev(spark, sf_dir), AT, LATER, NOW)[0].select("id", "subject")


@query(_DELTA.format("* FROM a ANTI JOIN b USING (id)"))
def since_gone(spark, sf_dir):
    return T.delta(claims_ev(spark, sf_dir), AT, LATER, NOW)[1].select("id", "subject")


@query(f"""WITH {CLAIMS_EV}, n AS (SELECT fact_key, count(*) AS n FROM claims_ev GROUP BY 1)
  SELECT count(*) AS slots, max(n) AS most, count_if(n > 3) AS crowded FROM n""", crowded="BIGINT")
def claims_per_slot(spark, sf_dir):
    n = claims_ev(spark, sf_dir).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("slots"), F.max("n").alias("most"), F.count_if(F.col("n") > 3).alias("crowded"))


@query(f"WITH {CLAIMS_EV} SELECT value_key, arg_min(id, (recorded_at, id)) AS canonical, count(*) AS n FROM claims_ev GROUP BY value_key")
def canonical_claim(spark, sf_dir):
    return claims_ev(spark, sf_dir).groupBy("value_key").agg(F.min_by("id", F.struct("recorded_at", "id")).alias("canonical"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLAIMS_EV}, l AS (SELECT *, max(valid_from) OVER (PARTITION BY fact_key ORDER BY recorded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM claims_ev)
  SELECT id, fact_key, valid_from, seen FROM l WHERE valid_from < seen""")
def late_arrivals(spark, sf_dir):
    return T.late(claims_ev(spark, sf_dir)).select("id", "fact_key", "valid_from", "seen")


@query(f"""WITH {CLAIMS_EV}, l AS (SELECT *, max(valid_from) OVER (PARTITION BY fact_key ORDER BY recorded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM claims_ev),
  ok AS (SELECT fact_key FROM l GROUP BY fact_key HAVING coalesce(bool_and(seen IS NULL OR valid_from >= seen), true))
  SELECT id, fact_key, valid_from, lead(valid_from) OVER w AS ended_at, lead(id) OVER w AS ended_by FROM claims_ev SEMI JOIN ok USING (fact_key) WINDOW w AS (PARTITION BY fact_key ORDER BY valid_from, recorded_at, id)""")
def supersede_chain(spark, sf_dir):
    """Slots whose facts arrived in order of the world clock: each value ends where the next begins."""
    return T.supersede_in_order(claims_ev(spark, sf_dir)).select("id", "fact_key", "valid_from", "ended_at", "ended_by")


@query(f"""WITH {CLAIMS_EV}, p AS (SELECT id, confidence, object, lag(id) OVER w AS old, lag(confidence) OVER w AS old_confidence, lag(object) OVER w AS old_object FROM claims_ev WINDOW w AS (PARTITION BY fact_key ORDER BY recorded_at, id))
  SELECT id, old, confidence, old_confidence FROM p WHERE old IS NOT NULL AND object <> old_object AND confidence < 0.6 * old_confidence""")
def authority_disputes(spark, sf_dir):
    """Claims too weak, against what they would displace, to end it (here under 0.6 of its confidence)."""
    return T.disputes(claims_ev(spark, sf_dir), 0.6).select("id", "old", "confidence", "old_confidence")


@query(_sql("valid_to <= valid_from", "id, valid_from, valid_to"))
def collapsed_intervals(spark, sf_dir):
    return claims_ev(spark, sf_dir).filter("valid_to <= valid_from").select("id", "valid_from", "valid_to")


_SPANS = """s AS (SELECT user_id, ts AS a, ts + to_hours((1 + event_id % 40)::INT) AS b, event_id FROM events),
  m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s)"""


@query(f"WITH {_SPANS} SELECT user_id, upto AS gap_from, a AS gap_to FROM m WHERE a > upto")
def interval_gaps(spark, sf_dir):
    """Parts of the time line that none of a subject's spans cover."""
    return T.gaps(_spans(spark, sf_dir), "user_id", "a", "b", "event_id").select("user_id", "gap_from", "gap_to")


@query(f"""WITH {_SPANS}, i AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS k FROM m)
  SELECT user_id, min(a) AS span_from, max(b) AS span_to, count(*) AS n FROM i GROUP BY user_id, k""")
def interval_islands(spark, sf_dir):
    return T.islands(_spans(spark, sf_dir), "user_id", "a", "b", "event_id").select("user_id", "span_from", "span_to", "n")


def _spans(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_id", F.col("ts").alias("a"), (F.col("ts") + F.make_dt_interval(F.lit(0), (1 + F.col("event_id") % 40).cast("int"))).alias("b"))


@query(f"""WITH {CLAIMS_EV} SELECT e.event_id, c.id FROM events e ASOF JOIN (SELECT * FROM claims_ev WHERE predicate = 'purchase') c ON c.usr = e.user_id::VARCHAR AND c.valid_from <= e.ts WHERE e.event_type = 'error'""")
def asof_match(spark, sf_dir):
    """For each error the latest purchase claim of its user at that instant (the row with the last id, of equals)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'")
    left = ev.select(F.col("user_id").cast("string").alias("usr"), "event_id", "ts")
    right = claims_ev(spark, sf_dir).filter("predicate = 'purchase'").select("usr", "id", F.col("valid_from").alias("ts"), F.col("event_id").alias("seq"))
    return T.as_of(left, right, "usr", "ts", "id", "seq").filter("id IS NOT NULL").select("event_id", "id")


@query(f"""WITH {CLAIMS_EV} SELECT a.id AS a, b.id AS b FROM claims_ev a JOIN claims_ev b ON a.subject = b.subject AND a.predicate = 'signup' AND b.predicate = 'error'
  AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND coalesce(a.valid_to > a.valid_from, true) AND coalesce(b.valid_to > b.valid_from, true)""")
def overlap_join(spark, sf_dir):
    c = claims_ev(spark, sf_dir)
    a = c.filter("predicate = 'signup'").select("subject", F.col("id").alias("a"), F.col("valid_from").alias("af"), F.col("valid_to").alias("at"))
    b = c.filter("predicate = 'error'").select("subject", F.col("id").alias("b"), F.col("valid_from").alias("bf"), F.col("valid_to").alias("bt"))
    return a.join(b, "subject").filter(C.overlaps(F.col("af"), F.col("at"), F.col("bf"), F.col("bt"))).select("a", "b")


@query(f"""WITH {CLAIMS_EV}, r AS (SELECT id, recorded_at, value_key, row_number() OVER (ORDER BY recorded_at DESC, value_key, id) AS pos FROM claims_ev
  WHERE recorded_at < TIMESTAMP '{AT}' QUALIFY pos <= 51) SELECT id, recorded_at, pos = 51 AS has_more FROM r""")
def keyset_page(spark, sf_dir):
    """A page of 50 rows after a cursor, and one row of look-ahead."""
    return T.page(claims_ev(spark, sf_dir), ("recorded_at", C.instant(AT)), 50).select("id", "recorded_at", "has_more")


@query(f"""WITH {CLAIMS_EV} SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, recorded_at DESC, id) AS pos FROM claims_ev
  WHERE {_known(NOW)} AND {_holds(NOW)} AND {_FRESH} QUALIFY pos <= 3""", pos="INT")
def standing(spark, sf_dir):
    live = T.read(claims_ev(spark, sf_dir), [C.LIVE], NOW, NOW, NOW)
    w = W.partitionBy("subject").orderBy(F.desc("confidence"), F.desc("recorded_at"), "id")
    return live.withColumn("pos", F.row_number().over(w)).filter("pos <= 3").select("subject", "id", "pos")


@query(f"""WITH {CLAIMS_EV} SELECT fact_key, list(object ORDER BY valid_from, event_id) FILTER ({_known(NOW)} AND {_holds(NOW)}) AS now_values,
  list(object ORDER BY valid_from, event_id) FILTER ({_known(NOW)} AND {_holds(AT)}) AS then_values, count(*) AS n FROM claims_ev
  WHERE subject IN (SELECT DISTINCT subject FROM claims_ev WHERE object = '7') GROUP BY fact_key""")
def ask_readings(spark, sf_dir):
    """Each slot of the subjects concerned as it is now and as it was at an instant."""
    c = claims_ev(spark, sf_dir)
    about = c.filter("object = '7'").select("subject").distinct()
    return T.readings(c.join(about, "subject", "left_semi"), AT, NOW).select("fact_key", "now_values", "then_values", "n")
