"""Where claims come from: citations both ways, displaced rows, links, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def why(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    """claim, pos, episode: each claim's sources in order, with the turn's row. claims: id, sources (array)."""
    cited = claims.select(F.col("id").alias("claim"), F.posexplode("sources").alias("pos", "episode"))
    return cited.join(episodes.withColumnRenamed("id", "episode"), "episode")


def produced(claims: DataFrame) -> DataFrame:
    """episode, claim of every citation, each pair once."""
    return claims.select(F.explode("sources").alias("episode"), F.col("id").alias("claim")).distinct()


def displaced(claims: DataFrame, known_at) -> DataFrame:
    """id and by: rows closed in favour of a successor that was itself known."""
    by = claims.filter(F.col("recorded_at") <= known_at).select(F.col("id").alias("by"))
    return claims.filter("invalidated_by IS NOT NULL").select("id", F.col("invalidated_by").alias("by")).join(by, "by", "left_semi")


def links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """id, other, relation, outgoing of links at either end; a self link counts once."""
    out = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "relation", F.lit(True).alias("outgoing"))
    back = links.filter("from_id <> to_id").select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "relation", F.lit(False).alias("outgoing"))
    return out.unionAll(back).join(ids, "id", "left_semi")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, each key once, that existing does not hold."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def orphans(episodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Turns that no claim cites."""
    cited = claims.select(F.explode("sources").alias("id")).distinct()
    return episodes.join(cited, "id", "left_anti")
