"""Conditions and derived columns of single claims: what can be walked, who derived it, how it is filed, which is later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions import clocks as C

PROCEDURAL, SEMANTIC, NOTE = "procedural", "semantic", "note"
OWNER_SEP = "\x1f"
# Spellings of units under their canonical names.
UNITS = {
    "minute": ["min", "mins", "minute", "minutes"],
    "hour": ["h", "hr", "hrs", "hour", "hours"],
    "day": ["day", "days"],
    "kilometer": ["km", "kms", "kilometer", "kilometers", "kilometre", "kilometres"],
    "mile": ["mi", "mile", "miles"],
    "kilogram": ["kg", "kgs", "kilogram", "kilograms"],
    "usd": ["$", "usd", "dollar", "dollars"],
    "eur": ["eur", "euro", "euros"],
    "gbp": ["gbp", "pound", "pounds"],
}


def walkable() -> Column:
    """Claims that are edges: affirmed, between two named and different things, with an object that is an entity or of no stated kind."""
    kind = F.col("object_kind").isNull() | (F.col("object_kind") == "entity")
    named = (F.col("subject_key") != "") & (F.col("object_key") != "")
    return F.coalesce((F.col("polarity") > 0) & named & (F.col("subject_key") != F.col("object_key")) & kind, F.lit(False))


def derived(derivation: Column, extractor: Column) -> Column:
    """Whether a component worked the claim out, rather than a caller stating it."""
    return ~F.coalesce((derivation == "user") & F.coalesce(extractor, F.lit("")).isin("", "api"), F.lit(False))


def believed_by(known_at) -> Column:
    """Whether the claim had been recorded by then."""
    return F.col("recorded_at") <= C.instant(known_at)


def filed(memory_type: Column, subject: Column, predicate: Column) -> Column:
    """The type a claim is kept under: only the user and projects have procedures, and notes stay as they were filed."""
    own = (subject == "user") | subject.startswith("project:") | (predicate == NOTE)
    return F.when((memory_type == PROCEDURAL) & ~F.coalesce(own, F.lit(False)), SEMANTIC).otherwise(memory_type)


def _first_of_month(at: Column, months: Column) -> Column:
    there = F.timestamp_add("MONTH", months, at)
    return there - F.make_dt_interval(F.dayofmonth(there) - 1)


def upper_bound(start: Column, precision: Column) -> Column:
    """Where the span ends that a stated start stands for: the start itself for an instant, else the next day, week, month, season or year."""
    days = F.when(precision == "day", 1).when(precision == "week", 7)
    months = F.when(precision == "month", 1).when(precision == "season", 3).when(precision == "year", 13 - F.month(start))
    return F.when(days.isNotNull(), start + F.make_dt_interval(days)).when(months.isNotNull(), _first_of_month(start, months)).otherwise(start)


def is_after(start: Column, other: Column, other_precision: Column) -> Column:
    """Whether a start lies surely after another claim's: not before the end of its span, and later than its start."""
    return (start >= upper_bound(other, other_precision)) & (start > other)


def iso_utc(at: Column) -> Column:
    """An instant as text, to the second, in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def spoken_day(at: Column) -> Column:
    """A day as one says it: 24 June 2026."""
    return F.date_format(at, "d MMMM yyyy")


def canonical_unit(unit: Column) -> Column:
    """The canonical name of a unit; an unknown one trimmed and in lower case, an empty one null."""
    plain = F.lower(F.trim(unit))
    out = F.when(plain != "", plain)
    for name, spellings in UNITS.items():
        out = F.when(plain.isin(spellings), name).otherwise(out)
    return out


def entity_id(owner: Column, key: Column) -> Column:
    """An entity's id: entities belong to an owner, so two users' may bear the same name."""
    return F.concat(owner, F.lit(OWNER_SEP), key)


def entity_owner(eid: Column) -> Column:
    """The owner in an id; empty if it names none. The owner may itself hold the separator, the key does not."""
    last = F.length(F.substring_index(eid, OWNER_SEP, -1))
    return F.when(F.contains(eid, F.lit(OWNER_SEP)), F.substring(eid, F.lit(1), F.length(eid) - last - 1)).otherwise("")


def entity_name(eid: Column) -> Column:
    return F.substring_index(eid, OWNER_SEP, -1)


def tenant_of(owner: Column) -> Column:
    return F.substring_index(owner, OWNER_SEP, 1)


def unit_vector(v: Column) -> Column:
    """A vector of length 1 in the same direction; null for one of length 0. Elements that are null stay so and add nothing to the length."""
    square = lambda x: F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + square(x), lambda s: F.when(s > 0, F.transform(v, lambda x: x.cast("double") / F.sqrt(s))))


def round_scaled(x: Column, digits: int) -> Column:
    """A double rounded as C and SQL engines on doubles do it: the scaled number, halves away from zero, -0.0 for small negative ones.
    Spark's own round goes by the decimal digits of the unscaled number and drops the sign of zero."""
    scaled = x * 10.0**digits
    return F.signum(scaled) * F.round(F.abs(scaled)) / 10.0**digits
