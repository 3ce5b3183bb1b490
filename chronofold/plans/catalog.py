"""All queries of the library, and their SQL equivalents."""

from __future__ import annotations

from chronofold.plans import lookups, ranking, reading, relations, search, temporal, upkeep  # noqa: F401
from chronofold.plans.registry import ORACLES, QUERIES

FLAGSHIP = "states_asof"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
