"""Orders, cuts and merges of ranked lists, per query: one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interleave(claims: DataFrame, turns: DataFrame, k: int) -> DataFrame:
    """qid, id, kind, pos: each turn goes before the first claim (in claim order) that scores less; claims keep their order.

    claims: qid, id, score, pos. turns: qid, id, score. The position of a turn is found with a running minimum over claims: the first claim
    below a score is the first place where the running minimum is below it, so both lists meet in one sorted union.
    """
    lowest = F.min("score").over(W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    c = claims.select("qid", "id", "pos", lowest.alias("low"))
    # places where the running minimum falls: of equal minima the first
    steps = c.groupBy("qid", "low").agg(F.min("pos").alias("pos")).withColumn("is_turn", F.lit(0))
    t = turns.select("qid", F.col("score").alias("low"), "id").withColumn("is_turn", F.lit(1))
    both = steps.unionByName(t, allowMissingColumns=True)
    # going up in score, the last step strictly below a turn's score is the least fall beneath it: the earliest such place is its largest minimum
    before = W.partitionBy("qid").orderBy("low", F.desc("is_turn")).rowsBetween(W.unboundedPreceding, -1)
    at = both.withColumn("at", F.last(F.when(F.col("is_turn") == 0, F.col("pos")), ignorenulls=True).over(before)).filter("is_turn = 1")
    rows = claims.select("qid", "id", F.lit("claim").alias("kind"), F.col("pos").cast("double").alias("key"), F.lit(1).alias("after"), F.col("score"))
    rows = rows.unionByName(at.select("qid", "id", F.lit("turn").alias("kind"), F.coalesce("at", F.lit(1 << 40)).cast("double").alias("key"), F.lit(0).alias("after"), F.col("low").alias("score")))
    w = W.partitionBy("qid").orderBy("key", "after", F.desc("score"), "id")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("qid", "id", "kind", "pos")


def relative_floor(rows: DataFrame, share: float) -> DataFrame:
    """Rows with at least a share of their query's best score; the best one always stays."""
    best = F.max("score").over(W.partitionBy("qid"))
    first = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return rows.withColumn("_b", best).withColumn("_r", first).filter((F.col("score") >= share * F.col("_b")) | (F.col("_r") == 1)).drop("_b", "_r")


def rerank_head(rows: DataFrame, top_n: int) -> DataFrame:
    """New positions: the first top_n by their external score (column extra), stably; the tail as it was."""
    head = F.when(F.col("pos") <= top_n, -F.col("extra"))
    w = W.partitionBy("qid").orderBy(F.when(F.col("pos") <= top_n, 0).otherwise(1), head, "pos")
    return rows.withColumn("new_pos", F.row_number().over(w))


def keep_selected(rows: DataFrame, scale: float, shift: float, threshold: float, most: int) -> DataFrame:
    """Rows whose calibrated probability reaches the threshold, the best `most` of each query, in their own order."""
    p = F.round(1 / (1 + F.exp(-(scale * F.col("extra") + shift))), 6)
    kept = rows.withColumn("p", p).filter(F.col("p") >= threshold)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("p"), "pos"))).filter(F.col("_r") <= most).drop("_r")


def seeds(rows: DataFrame, n: int) -> DataFrame:
    """qid, node, pos: both ends of the best rows (qid, pos, subject_key, object_key), each node once, the first n."""
    ends = rows.select("qid", "pos", F.posexplode(F.array("subject_key", "object_key")).alias("end", "node"))
    first = ends.groupBy("qid", "node").agg(F.min(F.struct("pos", "end")).alias("at"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("at", "node"))).filter(F.col("pos") <= n).select("qid", "node", "pos")


def phrasings(lists: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """qid, id, fused of several phrasings' lists (qid, phrasing, id, rank): summed reciprocal ranks, ties by first sight."""
    fused = lists.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 6).alias("fused"), F.min(F.struct("phrasing", "rank")).alias("seen"))
    w = W.partitionBy("qid").orderBy(F.desc("fused"), "seen", "id")
    return fused.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("qid", "id", "fused", "pos")


def latest_before(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Each row with the id of the copy (equal key) before it."""
    return rows.withColumn("previous", F.lag("id").over(W.partitionBy(key).orderBy(ts, tie)))


def ordered_union(a: Column, b: Column) -> Column:
    """Elements of both arrays, each once, in order of first sight."""
    return F.array_distinct(F.concat(a, b))
