"""Writes and upkeep as transformations from one snapshot to the next: close, forget, erase with proof, purge, merge, promote.

Parquet has no row-level updates, so each returns the new snapshot (or the rows concerned); save() writes a version and
then its commit mark, an empty file made only if there is none. Old versions must be removed for an erasure to be complete, and expunge() does so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C


def close_out(claims: DataFrame, which: Column, at, close: str = "retired", by: str | None = None) -> DataFrame:
    """Close rows: retired stamps invalidated_at, ended moves valid_to to max(at, valid_from) if that shortens it. Rows already retired stay as they are."""
    t = C.instant(at)
    hit = which & F.col("invalidated_at").isNull()
    out = claims
    if close == "retired":
        out = out.withColumn("invalidated_at", F.when(hit, t).otherwise(F.col("invalidated_at")))
    elif close == "ended":
        end = F.greatest(t, F.col("valid_from"))
        out = out.withColumn("valid_to", F.when(hit & (F.col("valid_to").isNull() | (end < F.col("valid_to"))), end).otherwise(F.col("valid_to")))
    else:
        raise ValueError("close is ended or retired")
    if by is not None and "invalidated_by" in claims.columns:
        out = out.withColumn("invalidated_by", F.when(hit, F.lit(by)).otherwise(F.col("invalidated_by")))
    return out


def forget(claims: DataFrame, slots: DataFrame, at, now) -> DataFrame:
    """Retire whatever is unended in these slots (fact_key)."""
    marked = claims.join(slots.select("fact_key").distinct().withColumn("_hit", F.lit(True)), "fact_key", "left")
    return close_out(marked, F.coalesce("_hit", F.lit(False)) & C.unended_expr(now, at), at).drop("_hit")


def erase(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (with the column that names the claim) without the rows of these ids."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    return {name: df.join(gone, df[column] == gone["_id"], "left_anti") for name, (df, column) in tables.items()}


def proof(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> DataFrame:
    """store and residue: rows that still mention an erased id, by table."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    out = None
    for name, (df, column) in sorted(tables.items()):
        n = df.join(gone, df[column] == gone["_id"], "left_semi").agg(F.count(F.lit(1)).alias("residue")).select(F.lit(name).alias("store"), "residue")
        out = n if out is None else out.unionAll(n)
    return out


def merge_predicate(claims: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Claims under canonical predicate names, with their slot keys made anew."""
    names = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    out = claims.withColumn("predicate", F.coalesce(F.try_element_at(names, "predicate"), "predicate"))
    return out.withColumn("fact_key", F.concat_ws("|", "subject", "predicate"))


def merge_values(claims: DataFrame) -> DataFrame:
    """Repeats of a value folded into the best of them: most observed, then earliest, then least id. Columns: id, value_key, obs_count, salience, recorded_at."""
    best = F.max_by("id", F.struct("obs_count", -F.unix_micros(F.col("recorded_at").cast("timestamp")), F.col("id")))
    return claims.groupBy("value_key").agg(best.alias("id"), F.sum("obs_count").alias("obs_count"), F.least(F.lit(5.0), F.round(F.sum("salience"), 6)).alias("salience"), F.count(F.lit(1)).alias("merged"))


def promote(claims: DataFrame, least: int = 3) -> DataFrame:
    """Values seen often enough to count as general knowledge: subject, predicate, object, n."""
    return claims.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def survivors(claims: DataFrame) -> DataFrame:
    """Of each slot the row that outlives a merge."""
    w = W.partitionBy("fact_key").orderBy(F.desc("obs_count"), "recorded_at", "id")
    return claims.withColumn("rank", F.row_number().over(w))


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions in order; none where there is no store."""
    path, fs = _files(spark, root)
    marks = path(f"{root}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(marks)) if fs.exists(marks) else []


def save(df: DataFrame, root: str, version: int) -> None:
    """Write a version, then commit it: readers see the one before until the mark is there. Nothing is overwritten; a second writer of the same version fails."""
    df.write.mode("errorifexists").parquet(f"{root}/v={version:010d}")
    path, fs = _files(df.sparkSession, root)
    fs.create(path(f"{root}/commits/{version:010d}"), False).close()


def load(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={versions(spark, root)[-1]:010d}")


def expunge(spark: SparkSession, root: str) -> None:
    """Delete every version but the current one."""
    *old, version = versions(spark, root)
    path, fs = _files(spark, root)
    for v in old:
        fs.delete(path(f"{root}/commits/{v:010d}"), False)
    for f in fs.listStatus(path(root)):
        name = f.getPath().getName()
        if name.startswith("v=") and name != f"v={version:010d}":
            fs.delete(f.getPath(), True)
