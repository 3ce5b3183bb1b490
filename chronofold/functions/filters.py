"""Filters on JSON metadata: typed equality, so 1, true and "1" are three values. Expressions only: they run in the scan's stage."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"[A-Za-z0-9_.-]{1,64}")


def meta_filter(meta: Column, wanted: Mapping[str, object]) -> Column:
    """Every key must hold one of its values."""
    variant = F.try_parse_json(meta)
    cond = F.lit(True)
    for key, values in wanted.items():
        if not _KEY.fullmatch(key):
            raise ValueError(f"not a metadata key: {key!r}")
        got = F.try_variant_get(variant, f"$['{key}']", "variant")
        kind = F.schema_of_variant(got)
        any_of = F.lit(False)
        for v in values if isinstance(values, (list, tuple, set)) else [values]:
            any_of = any_of | _equals(got, kind, v)
        cond = cond & F.coalesce(any_of, F.lit(False))
    return cond


def _equals(got: Column, kind: Column, value) -> Column:
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(got, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return kind.isin("BIGINT", "DOUBLE") & (F.try_variant_get(got, "$", "double") == F.lit(float(value))) | kind.startswith("DECIMAL") & (F.try_variant_get(got, "$", "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(got, "$", "string") == F.lit(value))
    raise TypeError(f"no filter on {type(value).__name__}")


def path_prefix(path: Column, prefix: str) -> Column:
    """A literal prefix: percent signs and underscores mean themselves."""
    return path.startswith(F.lit(prefix))


def all_named(key_words: Column, query_tokens: Column) -> Column:
    """Whether the query names every word of a key: the anchor test."""
    return (F.size(key_words) > 0) & (F.size(F.array_except(key_words, query_tokens)) == 0)
