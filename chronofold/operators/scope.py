"""Hierarchical scopes: tenant > user > project > agent > session. A null level is not bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("tenant", "usr", "project", "agent", "session")


def scope_key(*levels: Column) -> Column:
    """Levels joined by slashes, a star for an unbound one, with the three marks escaped inside values."""

    def one(c: Column) -> Column:
        for mark, code in (("%", "%25"), ("/", "%2F"), ("*", "%2A")):
            c = F.replace(c, F.lit(mark), F.lit(code))
        return F.coalesce(c, F.lit("*"))

    return F.concat_ws("/", *(one(c) for c in levels))


def chain(readers: DataFrame) -> DataFrame:
    """Each reader's scopes with level_rank, narrowest first, without repeats: at most seven rows a reader.

    readers: reader and the five levels. The agent's and session's own rows come with the project and again without it.
    """
    null = F.lit(None).cast("string")
    t, u, p, a, s = (F.col(c) for c in LEVELS)

    def level(rank: int, when: Column, *values: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("level_rank"), *(v.cast("string").alias(n) for v, n in zip(values, LEVELS, strict=True))))

    yes = F.lit(True)
    rows = F.array_compact(F.array(
        level(0, yes, t, u, p, a, s), level(1, s.isNotNull(), t, u, p, a, null), level(2, a.isNotNull(), t, u, p, null, null),
        level(3, p.isNotNull() & s.isNotNull(), t, u, null, a, s), level(4, p.isNotNull() & a.isNotNull(), t, u, null, a, null),
        level(5, p.isNotNull(), t, u, null, null, null), level(6, u.isNotNull(), t, null, null, null, null),
    ))
    out = readers.select("reader", F.explode(rows).alias("x")).select("reader", "x.*")
    return out.groupBy("reader", *LEVELS).agg(F.min("level_rank").alias("level_rank"))


def visible(claims: DataFrame, readers: DataFrame) -> DataFrame:
    """Claims at any scope of each reader's chain: an equi-join that takes null for equal, on all levels; adds reader and level_rank."""
    c = chain(readers)
    on = [claims[n].eqNullSafe(c[n]) if n in claims.columns else c[n].isNull() for n in LEVELS]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return claims.join(c, cond).select(c["reader"], c["level_rank"], *(claims[n] for n in claims.columns))


def shadow(rows: DataFrame, slot: str = "fact_key", functional: Column | None = None) -> DataFrame:
    """Of rows of single-valued predicates, those at the narrowest level of the reader that holds the slot; others stay."""
    best = F.min("level_rank").over(W.partitionBy("reader", slot))
    kept = rows.withColumn("_best", best)
    keep = F.col("level_rank") == F.col("_best")
    return kept.filter(keep if functional is None else keep | ~functional).drop("_best")


def contains(outer: dict[str, str | None]) -> Column:
    """Rows at a scope or anywhere below it: what deletes reach."""
    cond = F.lit(True)
    for n in LEVELS:
        if outer.get(n) is not None:
            cond = cond & F.col(n).eqNullSafe(F.lit(outer[n]))
    return cond
