"""Lookups over whole sets at a time: by id, by slot, by chunk, by name; and the merging and cutting of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C


def by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these ids (column id): one semi join, whatever the number of ids; the optimizer broadcasts them if they are few."""
    return rows.join(ids.select("id"), "id", "left_semi")


def stored_in(claims: DataFrame, states) -> DataFrame:
    """All claims in these stored states, no clock asked: one scan."""
    return claims.filter(C.stored_state().isin(list(states)))


def competing(claims: DataFrame, known_at, valid_at) -> DataFrame:
    """fact_key and n: how many live claims stand in each slot that has any."""
    return claims.filter(C.live_expr(known_at, valid_at)).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"))


def chunk_turns(chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """Chunks (document, position, id) with the content of the turns they point at."""
    return chunks.join(turns.select("id", "content"), "id").select("document", "position", "id", "content")


def resolve_entities(mentions: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions (key, ...) with entity and resolution: empty, alias, known or novel. An alias (key, target) comes before a name of its own:
    a merged entity may still have its row in known (key). Keys of known and aliases are distinct."""
    named = mentions.join(aliases.select("key", "target"), "key", "left").join(known.select("key", F.lit(True).alias("_known")), "key", "left")
    how = F.when(F.coalesce("key", F.lit("")) == "", "empty").when(F.col("target").isNotNull(), "alias").when(F.col("_known"), "known").otherwise("novel")
    entity = F.when(F.coalesce("key", F.lit("")) == "", "").otherwise(F.coalesce("target", "key"))
    return named.withColumn("resolution", how).withColumn("entity", entity).drop("target", "_known")


def shortlist(surfaces: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """qid, key, shared and pos: of the names (key) in the pool that share words with a surface (qid, name) the k that share most, then by name."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != "")))
    hits = surfaces.select("qid", words(F.col("name")).alias("word")).join(pool.select("key", words(F.col("key")).alias("word")), "word")
    counted = hits.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("shared"))
    return counted.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("shared"), "key"))).filter(F.col("pos") <= k)


def merge_hits(*lists: DataFrame) -> DataFrame:
    """qid, id and the best score of a hit in any of the lists."""
    both = lists[0].select("qid", "id", "score")
    for other in lists[1:]:
        both = both.unionByName(other.select("qid", "id", "score"))
    return both.groupBy("qid", "id").agg(F.max("score").alias("score"))


def best_of(results: DataFrame, k: int, types=None, least: float | None = None) -> DataFrame:
    """The k best of each query (qid, id, type, score), in order (pos). Types and the floor are tested before the cut, so no query comes short for hits of other types."""
    rows = results
    if types is not None:
        rows = rows.filter(F.col("type").isin(list(types)))
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("pos") <= k)


def uncovered(spans: DataFrame, cover: DataFrame, key: str) -> DataFrame:
    """key, gap_from, gap_to: what of each key's one span [since, until) none of its cover rows (since, until) covers.

    One equi join clips the cover to the span, then one window finds the gaps; nothing is paired but a key's span and its cover.
    """
    s = spans.select(key, F.col("since").alias("_a"), F.col("until").alias("_b")).filter("_a < _b")
    clipped = cover.select(key, "since", "until").join(s, key).select(key, F.greatest("since", "_a").alias("since"), F.least("until", "_b").alias("until")).filter("since < until")
    ends = s.select(key, F.explode(F.array("_a", "_b")).alias("since")).withColumn("until", F.col("since"))
    upto = F.max("until").over(W.partitionBy(key).orderBy("since", "until").rowsBetween(W.unboundedPreceding, -1))
    return clipped.unionByName(ends).withColumn("gap_from", upto).filter("since > gap_from").select(key, "gap_from", F.col("since").alias("gap_to"))
