"""Reads over two clocks: states, history, deltas, as-of matches, intervals. All are built-in operators, one shuffle at most each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import clocks as C


def read(claims: DataFrame, states: Iterable[str], known_at, valid_at, now, start=None) -> DataFrame:
    """Claims in these states at (known_at, valid_at), or through the window [start, valid_at], that have not expired by now."""
    return claims.filter(C.state_expr(states, known_at, valid_at, start) & C.unexpired_expr(now))


def history(claims: DataFrame, known_at, now, valid_at=None) -> DataFrame:
    """Every row of a slot in the order it was told, numbered."""
    rows = claims.filter(C.timeline_expr(known_at, valid_at) & C.unexpired_expr(now))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("fact_key").orderBy("recorded_at", "id")))


def stated_expr(at) -> Column:
    """What would have been said at an instant; needs successor and successor_recorded."""
    t = C.instant(at)
    open_ = F.col("valid_to").isNull() | (F.col("valid_to") > t) | (F.col("successor").isNotNull() & (F.col("successor_recorded") > t))
    return (F.col("recorded_at") <= t) & (F.col("valid_from") <= t) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t)) & open_


def delta(claims: DataFrame, then, now, wall) -> tuple[DataFrame, DataFrame]:
    """(added, gone) between two instants: rows live at one of them only.

    Both memberships are properties of a row, so the two set differences need no join at all.
    """
    before, after = C.live_expr(then, then), C.live_expr(now, now)
    fresh = claims.filter(C.unexpired_expr(wall))
    return fresh.filter(after & ~F.coalesce(before, F.lit(False))), fresh.filter(before & ~F.coalesce(after, F.lit(False)))


def late(claims: DataFrame) -> DataFrame:
    """Rows that begin before something their slot had already been told."""
    w = W.partitionBy("fact_key").orderBy("recorded_at", "id").rowsBetween(W.unboundedPreceding, -1)
    return claims.withColumn("seen", F.max("valid_from").over(w)).filter("valid_from < seen")


def supersede_in_order(claims: DataFrame) -> DataFrame:
    """The fast path of reconciliation, for slots without late arrivals; others go through the fold."""
    told = W.partitionBy("fact_key").orderBy("recorded_at", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = claims.withColumn("is_late", F.coalesce(F.col("valid_from") < F.max("valid_from").over(told), F.lit(False)))
    rows = rows.withColumn("any_late", F.max("is_late").over(W.partitionBy("fact_key"))).filter(~F.col("any_late"))
    w = W.partitionBy("fact_key").orderBy("valid_from", "recorded_at", "id")
    return rows.withColumn("ended_at", F.lead("valid_from").over(w)).withColumn("ended_by", F.lead("id").over(w))


def disputes(claims: DataFrame, share: float = 0.5) -> DataFrame:
    """Neighbours in a slot's arrival order where the newcomer has under a share of the confidence it would displace."""
    w = W.partitionBy("fact_key").orderBy("recorded_at", "id")
    rows = claims.withColumn("old", F.lag("id").over(w)).withColumn("old_confidence", F.lag("confidence").over(w)).withColumn("old_object", F.lag("object").over(w))
    return rows.filter(F.col("old").isNotNull() & (F.col("object") != F.col("old_object")) & (F.col("confidence") < share * F.col("old_confidence")))


def _upto(spans: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(start, tie).rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("upto", F.max(end).over(w))


def gaps(spans: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """gap_from and gap_to between the spans of a key."""
    return _upto(spans, key, start, end, tie).filter(F.col(start) > F.col("upto")).withColumnsRenamed({"upto": "gap_from", start: "gap_to"})


def islands(spans: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Maximal covered stretches of a key."""
    rows = _upto(spans, key, start, end, tie)
    new = F.when(F.col("upto").isNull() | (F.col(start) > F.col("upto")), 1).otherwise(0)
    rows = rows.withColumn("k", F.sum(new).over(W.partitionBy(key).orderBy(start, tie).rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "k").agg(F.min(start).alias("span_from"), F.max(end).alias("span_to"), F.count(F.lit(1)).alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, seq: str) -> DataFrame:
    """left with the value of right's last row at or before its instant, by key: one union, one shuffle, one sort, no range join."""
    l = left.withColumn("_r", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_seq", F.lit(None).cast("long"))
    r = right.select(key, ts, F.col(value).alias("_v"), F.col(seq).alias("_seq")).withColumn("_r", F.lit(0))
    w = W.partitionBy(key).orderBy(ts, "_r", "_seq").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_r = 1").drop("_r", "_v", "_seq")


def page(claims: DataFrame, cursor: tuple[str, Column], size: int) -> DataFrame:
    """size rows after a cursor in listing order (newest first), and one more, marked has_more, if there are more."""
    column, at = cursor
    rows = claims.filter(F.col(column) < at).orderBy(F.desc(column), "value_key", "id").limit(size + 1)
    return rows.withColumn("has_more", F.row_number().over(W.orderBy(F.desc(column), "value_key", "id")) == size + 1)


def readings(claims: DataFrame, then, now) -> DataFrame:
    """Of each slot its values now and then, as told by now."""

    def values(valid_at) -> Column:
        kept = F.when(C.live_expr(now, valid_at), F.struct("valid_from", "event_id", "object"))
        listed = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["object"])
        return F.when(F.size(listed) > 0, listed)

    return claims.groupBy("fact_key").agg(values(now).alias("now_values"), values(then).alias("then_values"), F.count(F.lit(1)).alias("n"))
