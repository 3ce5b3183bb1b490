"""Predicates over the two time axes.

A claim is recorded at ``recorded_at`` and retired at ``invalidated_at`` (belief clock K); it holds from ``valid_from`` until
``valid_to`` (world clock V). Null ends are open. Expiry is a third matter and always measured on the wall clock.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIVE, ENDED, RETIRED = "live", "ended", "retired"
STATES = (LIVE, ENDED, RETIRED)


def instant(at: str | Column) -> Column:
    """An instant without zone, as all instants are stored (UTC)."""
    return F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at


def _open(column: Column, at: Column) -> Column:
    return column.isNull() | (column > at)


def state_expr(states: Iterable[str], known_at, valid_at, start=None) -> Column:
    """Whether a row is in one of the states at (known_at, valid_at).

    start: reads a window [start, valid_at] of the world clock instead of an instant. With all three states only the
    belief clock's floor is left: an audit read.
    """
    wanted = set(states)
    if not wanted or wanted - set(STATES):
        raise ValueError(f"states are some of {STATES}")
    k, v = instant(known_at), instant(valid_at)
    known = F.col("recorded_at") <= k
    if wanted == set(STATES):
        return known
    begun, not_over = F.col("valid_from") <= v, _open(F.col("valid_to"), v if start is None else instant(start))
    over = F.col("valid_to").isNotNull() & (F.col("valid_to") <= v)
    world = {frozenset({LIVE}): begun & not_over, frozenset({ENDED}): over, frozenset({LIVE, ENDED}): begun}.get(frozenset(wanted - {RETIRED}))
    retired = F.col("invalidated_at").isNotNull() & (F.col("invalidated_at") <= k)
    if world is None:
        return known & retired
    if RETIRED in wanted:
        return known & (retired | world)
    return known & _open(F.col("invalidated_at"), k) & world


def live_expr(known_at, valid_at) -> Column:
    return state_expr([LIVE], known_at, valid_at)


def unended_expr(known_at, valid_at) -> Column:
    """Believed and not over, begun or not: what closing a slot closes."""
    k, v = instant(known_at), instant(valid_at)
    return (F.col("recorded_at") <= k) & _open(F.col("invalidated_at"), k) & _open(F.col("valid_to"), v)


def unexpired_expr(now) -> Column:
    return _open(F.col("expires_at"), instant(now))


def timeline_expr(known_at, valid_at=None) -> Column:
    """Membership in a timeline: known by K and, if V is given, holding at V."""
    known = F.col("recorded_at") <= instant(known_at)
    if valid_at is None:
        return known
    v = instant(valid_at)
    return known & (F.col("valid_from") <= v) & _open(F.col("valid_to"), v)


def stored_state() -> Column:
    """State without any clock, from the two closing columns."""
    return F.when(F.col("invalidated_at").isNotNull(), RETIRED).when(F.col("valid_to").isNotNull(), ENDED).otherwise(LIVE)


def happened_expr(known_at, valid_at) -> Column:
    """Turns have one clock."""
    return F.col("ts") <= F.least(instant(known_at), instant(valid_at))


def next_change(after) -> Column:
    """The row's earliest instant after a given one at which its state may change; null if none."""
    t = instant(after)
    return F.least(*(F.when(F.col(c) > t, F.col(c)) for c in ("recorded_at", "invalidated_at", "valid_from", "valid_to", "expires_at")))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open intervals with open (null) ends meet; empty ones meet nothing."""
    empty = (a_to <= a_from) | (b_to <= b_from)
    return (b_to.isNull() | (a_from < b_to)) & (a_to.isNull() | (b_from < a_to)) & ~F.coalesce(empty, F.lit(False))
