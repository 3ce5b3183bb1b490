"""Text, vector and hybrid retrieval; scoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.functions import scoring as S
from chronofold.functions.text import STOPWORDS, ascii_tokens, query_terms, tokens
from chronofold.operators import retrieval as R
from chronofold.plans.registry import query
from chronofold.sources.projections import CLAIMS_EV, claims_ev, table

NOW = "2024-02-20 00:00:00"

_TOK = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) >= 2)"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _bm25_sql(docs: str = "documents", terms: str = "list_distinct(" + _TOK.format("text") + ")", name: str = "bm25") -> str:
    return f"""tok AS (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents),
  st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok), p0 AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
  q AS (SELECT item_id AS qid, unnest({terms}) AS term FROM benchmark),
  h AS (SELECT id, term, count(*) AS f, max(dl) AS dl FROM p0 WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS d FROM h GROUP BY term),
  {name} AS (SELECT qid, id, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS bm25
    FROM h JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _distinct_tokens(text, tokenize):
    return F.array_distinct(tokenize(text))


@query(f"WITH {_bm25_sql()} SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS rank FROM bm25 QUALIFY rank <= 10", rank="INT")
def bm25_topk(spark, sf_dir):
    return R.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10, ascii_tokens, _distinct_tokens).select("qid", "id", "bm25", "rank")


@query(f"WITH {_bm25_sql(terms=f'list_distinct(list_filter({_TOK.format("text")}, lambda t: NOT list_contains({_STOP}, t)))')} SELECT qid, bm25.id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, bm25.id) AS rank FROM bm25 JOIN documents ON doc_id = bm25.id WHERE lang = 'en' QUALIFY rank <= 10", rank="INT")
def bm25_filtered(spark, sf_dir):
    """Statistics cover the whole corpus; the filter comes before the cut."""
    return R.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10, ascii_tokens, query_terms, F.col("lang") == "en").select("qid", "id", "bm25", "rank")


@query(f"WITH tok AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM tok GROUP BY term")
def term_stats(spark, sf_dir):
    rows = R.postings(_docs(spark, sf_dir), "id", "text", ascii_tokens)
    return rows.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


@query(None)
def bm25_unicode(spark, sf_dir):
    """The library's own tokenizer, over all scripts."""
    return R.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10, tokens, query_terms).select("qid", "id", "bm25", "rank")


@query(f"""WITH {_bm25_sql()}, top AS (SELECT qid, id, bm25 FROM bm25 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) <= 20),
  qt AS (SELECT item_id AS qid, list_distinct({_TOK.format('text')}) AS terms FROM benchmark)
  SELECT qid, id, round(len(list_intersect(terms, t)) / len(terms), 6) AS coverage FROM top JOIN qt USING (qid) JOIN tok USING (id)""")
def coverage_rerank(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    head = R.bm25(docs, asked, 20, ascii_tokens, _distinct_tokens)
    terms = asked.select("qid", F.array_distinct(ascii_tokens(F.col("text"))).alias("terms"))
    rows = docs.select("id", ascii_tokens(F.col("text")).alias("t")).join(head, "id").join(terms, "qid")
    return rows.select("qid", "id", F.round(R.coverage(F.col("t"), F.col("terms")), 6).alias("coverage"))


_VEC = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), qv AS (SELECT id AS qid, v AS qv, label AS qlabel FROM v WHERE id % 20 = 0),
  c AS (SELECT qid, id, label, qlabel, round(list_cosine_similarity(qv, v), 6) AS cosine FROM qv, v)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _query_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("qid"), "v")


@query(f"WITH {_VEC} SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM c QUALIFY rank <= 10", rank="INT")
def vector_topk(spark, sf_dir):
    return R.vector_topk(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10)


@query(f"WITH {_VEC} SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM c WHERE label < 3 QUALIFY rank <= 10", rank="INT")
def vector_topk_filtered(spark, sf_dir):
    return R.vector_topk(_vectors(spark, sf_dir).filter("label < 3"), _query_vectors(spark, sf_dir), 10)


@query(f"WITH {_VEC} SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM c WHERE id <> qid AND cosine >= 0.3 QUALIFY rank <= 5", rank="INT")
def near_neighbours(spark, sf_dir):
    """Candidates for near-duplicate vectors: nearest others over a threshold."""
    got = R.vector_topk(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 6, 0.3).filter("id <> qid").drop("rank")
    return R.top(got, "cosine", 5)


@query(f"""WITH {_VEC}, n AS (SELECT * FROM c WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) <= 10),
  l AS (SELECT qid, qlabel, label, count(*) AS n FROM n GROUP BY ALL) SELECT qid, qlabel, label AS voted, n AS votes FROM l QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1""")
def knn_label_vote(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = R.top(R.vector_topk(v, _query_vectors(spark, sf_dir), 11).filter("id <> qid").drop("rank"), "cosine", 10)
    votes = got.join(v.select("id", "label"), "id").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("votes"), "label"))).filter("r = 1")
    return best.join(v.select(F.col("id").alias("qid"), F.col("label").alias("qlabel")), "qid").select("qid", "qlabel", F.col("label").alias("voted"), "votes")


@query("SELECT 'embeddings' AS store, count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, count_if(embedding IS NULL) AS missing FROM embeddings", missing="BIGINT")
def vector_census(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"), F.count_if(F.col("embedding").isNull()).alias("missing")).withColumn("store", F.lit("embeddings"))


_LEGS = f"""{_bm25_sql()}, lex AS (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS rank FROM bm25 QUALIFY rank <= 50),
  tv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), qe AS (SELECT item_id AS qid, v AS qv FROM benchmark JOIN tv ON tv.id = item_id),
  vec AS (SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM (SELECT qid, tv.id, round(list_cosine_similarity(qv, v), 6) AS cosine FROM qe, tv) QUALIFY rank <= 50),
  f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused FROM (SELECT qid, id, rank FROM lex UNION ALL SELECT qid, id, rank FROM vec) GROUP BY ALL)"""


def _legs(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    lexical = R.bm25(_docs(spark, sf_dir), asked, 50, ascii_tokens, _distinct_tokens)
    vectors = _vectors(spark, sf_dir)
    q = vectors.withColumnRenamed("id", "qid").join(asked.select("qid"), "qid", "left_semi").select("qid", "v")
    return lexical, R.vector_topk(vectors, q, 50)


@query(f"WITH {_LEGS} SELECT qid, id, fused FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) <= 20")
def rrf_fusion(spark, sf_dir):
    lexical, vector = _legs(spark, sf_dir)
    return R.top(R.fuse([(vector, 1.0), (lexical, 1.0)]), "fused", 20).select("qid", "id", "fused")


@query(f"""WITH {_LEGS}, pool AS (SELECT qid, id FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) <= 60),
  nt AS (SELECT item_id AS qid, len(list_distinct({_TOK.format('text')})) AS n FROM benchmark),
  j AS (SELECT qid, p.id, cosine, bm25, n, exists(SELECT 1 FROM vec WHERE vec.qid = p.qid) AS von, exists(SELECT 1 FROM lex WHERE lex.qid = p.qid) AS lon, power(0.5, (p.id % 60) / 30.0) AS r, 0.5 + (p.id % 5) / 10.0 AS c, 1.0 AS s
    FROM pool p LEFT JOIN vec USING (qid, id) LEFT JOIN lex USING (qid, id) JOIN nt USING (qid) JOIN documents d ON d.doc_id = p.id),
  e AS (SELECT *, ((CASE WHEN von THEN coalesce(greatest(0, least(1, cosine)), 0) ELSE 0 END) + (CASE WHEN lon AND bm25 > 0 THEN (bm25 / n) / (bm25 / n + 1.5) ELSE 0 END)) / (von::INT + lon::INT) AS ev FROM j),
  g AS (SELECT qid, id, round(least(1, ev * least(1, (1 + 0.25 * r + 0.15 * c + 0.10 * s) / 1.5)), 6) AS score FROM e)
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM g QUALIFY pos <= 12""", pos="INT")
def hybrid_search(spark, sf_dir):
    """Both legs, fused for candidates, scored absolutely with each document's recency, confidence and salience."""
    lexical, vector = _legs(spark, sf_dir)
    n_terms = _asked(spark, sf_dir).select("qid", F.size(F.array_distinct(ascii_tokens(F.col("text")))).alias("n"))
    facts = _docs(spark, sf_dir).select("id", F.pow(F.lit(0.5), (F.col("id") % 60) / 30.0).alias("recency"), (0.5 + (F.col("id") % 5) / 10.0).alias("confidence"), F.lit(1.0).alias("salience"))
    return R.hybrid(vector, lexical, n_terms, facts, 12, 60)


@query(f"""WITH {_bm25_sql()}, r AS (SELECT qid, id, source AS slot, round((bm25 / n) / (bm25 / n + 1.5), 6) AS score FROM bm25 JOIN documents ON doc_id = id
    JOIN (SELECT item_id AS qid, len(list_distinct({_TOK.format('text')})) AS n FROM benchmark) USING (qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) <= 20),
  b AS (SELECT *, CASE WHEN score <= 0 THEN 2 WHEN row_number() OVER (PARTITION BY qid, slot ORDER BY score DESC, id) <= 2 THEN 0 ELSE 1 END AS bucket FROM r)
  SELECT qid, id, slot, score, row_number() OVER (PARTITION BY qid ORDER BY bucket, score DESC, id) AS pos FROM b""", pos="INT")
def slot_cap(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    hits = R.bm25(docs, asked, 20, ascii_tokens, _distinct_tokens)
    n = asked.select("qid", F.size(F.array_distinct(ascii_tokens(F.col("text")))).alias("n"))
    rows = hits.join(docs.select("id", F.col("source").alias("slot")), "id").join(n, "qid")
    return R.slot_cap(rows.select("qid", "id", "slot", F.round(S.lexical_relevance(F.col("bm25"), F.col("n")), 6).alias("score"))).select("qid", "id", "slot", "score", "pos")


@query(f"WITH {CLAIMS_EV} SELECT id, round(power(0.5, greatest(0, date_sub('second', valid_from, TIMESTAMP '{NOW}')) / 86400.0 / 30.0), 6) AS recency FROM claims_ev")
def recency_scores(spark, sf_dir):
    age = S.age_days(F.col("valid_from"), C.instant(NOW))
    return claims_ev(spark, sf_dir).select("id", F.round(S.decay(age, 30.0), 6).alias("recency"))


@query(f"WITH {CLAIMS_EV} SELECT id, round(least(1, (1 + 0.25 * power(0.5, greatest(0, date_sub('second', valid_from, TIMESTAMP '{NOW}')) / 86400.0 / 30.0) + 0.15 * confidence + 0.10 * 1.0) / 1.5), 6) AS quality FROM claims_ev")
def quality_scores(spark, sf_dir):
    age = S.age_days(F.col("valid_from"), C.instant(NOW))
    return claims_ev(spark, sf_dir).select("id", F.round(S.quality(S.decay(age, 30.0), F.col("confidence"), F.lit(1.0)), 6).alias("quality"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS qid, round(power(0.5, abs(date_sub('second', o_orderdate, TIMESTAMP '1996-06-01 00:00:00')) / 86400.0 / 30.0), 6) AS proximity FROM orders)
  SELECT qid, id, proximity FROM a QUALIFY max(proximity) OVER (PARTITION BY qid) >= 0.5 AND proximity > 0""")
def time_proximity(spark, sf_dir):
    """The leg abstains for a query whose nearest row is too far from the anchor."""
    days = F.abs(F.timestamp_diff("SECOND", F.col("o_orderdate"), C.instant("1996-06-01 00:00:00"))) / S.DAY_SECONDS
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.round(S.decay(days, S.PROXIMITY_DAYS), 6).alias("proximity"))
    near = rows.withColumn("best", F.max("proximity").over(W.partitionBy("qid")))
    return near.filter((F.col("best") >= S.PROXIMITY_FLOOR) & (F.col("proximity") > 0)).drop("best")


@query("SELECT o_orderkey AS id, round(greatest(0.05, (1 + o_totalprice / 1000000) * power(0.5, greatest(0, date_sub('second', o_orderdate, TIMESTAMP '1998-12-01 00:00:00')) / 86400.0 / CASE o_orderstatus WHEN 'F' THEN 3650 WHEN 'O' THEN 365 ELSE 30 END)), 6) AS salience FROM orders")
def salience_decay(spark, sf_dir):
    half = F.when(F.col("o_orderstatus") == "F", 3650).when(F.col("o_orderstatus") == "O", 365).otherwise(30)
    age = S.age_days(F.col("o_orderdate"), C.instant("1998-12-01 00:00:00"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.decayed_salience(1 + F.col("o_totalprice") / 1_000_000, age, half).alias("salience"))


@query("""WITH g AS (SELECT n_chars AS x, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
  s AS (SELECT x, (coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(pos) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE / (SELECT sum(pos + neg) FROM g) AS acc FROM g)
  SELECT arg_min(x, (-round(acc, 9), x)) AS threshold, round(max(acc), 6) AS accuracy FROM s""")
def calibrate_floor(spark, sf_dir):
    """The floor that separates hits from misses best; the lowest of equals.

    One pass: rows on either side of every candidate come from running sums over the distinct values, not from a cross join.
    """
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").alias("x"), "quality")
    by_x = t.groupBy("x").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") != 1).alias("neg"))
    return R_floor(by_x)


def R_floor(by_x, ranges=256):
    """threshold and accuracy over every x of by_x (x, pos, neg). Running sums are taken in two levels: within ranges of x, side by side, and over
    the sums of the ranges, of which there are so many at most."""
    cuts = by_x.agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first().cuts or []
    part = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    rows = by_x.withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before, after = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("under"), F.coalesce(F.sum("p").over(after), F.lit(0)).alias("over"), F.sum(F.col("p") + F.col("n")).over(W.partitionBy()).alias("every"))
    up = W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy("part").orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, 0)
    right = F.col("under") + F.coalesce(F.sum("neg").over(up), F.lit(0)) + F.col("over") + F.sum("pos").over(down)
    rows = rows.join(F.broadcast(sums), "part").withColumn("acc", right / F.col("every"))
    return rows.agg(F.min_by("x", F.struct(-F.round("acc", 9), F.col("x"))).alias("threshold"), F.round(F.max("acc"), 6).alias("accuracy"))


@query(f"""WITH {_bm25_sql()}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS rank FROM bm25 QUALIFY rank <= 20),
  g AS (SELECT qid, min(rank) AS first FROM r JOIN labels ON doc_id = id WHERE quality = 1 GROUP BY qid), a AS (SELECT item_id AS qid, first FROM benchmark LEFT JOIN g ON g.qid = item_id)
  SELECT count(*) AS n, round(avg(coalesce(first <= 1, false)::INT::DOUBLE), 6) AS r1, round(avg(coalesce(first <= 5, false)::INT::DOUBLE), 6) AS r5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM a""")
def retrieval_metrics(spark, sf_dir):
    """Recall at 1 and 5 and mean reciprocal rank, with documents labelled good as the relevant ones."""
    asked = _asked(spark, sf_dir)
    hits = R.bm25(_docs(spark, sf_dir), asked, 20, ascii_tokens, _distinct_tokens)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    first = hits.join(good, "id").groupBy("qid").agg(F.min("rank").alias("first"))
    rows = asked.select("qid").join(first, "qid", "left")
    at = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), at(1).alias("r1"), at(5).alias("r5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
