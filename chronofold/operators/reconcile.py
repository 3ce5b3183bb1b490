"""Reconciliation: an order-dependent fold per (tenant, user, subject) that decides for each assertion add, reinforce, supersede, retract or noop.

The fold is grouped by subject, the narrowest key closed under what it reads. It runs in applyInPandas; slots that arrived in order do
not need it (operators.temporal.supersede_in_order). Of the past a step looks only at the values of its predicate that are still
open, kept apart from the rows stored, so its cost grows with the values open at once and not with the history. An assertion that
names a row in `closes` decides nothing of its own: it ends or retires that row (`how`) from then on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTHORITY, BUMP, CAP = 0.5, 0.25, 5.0
SCHEMA = "subject string, id string, predicate string, object string, action string, valid_from timestamp_ntz, valid_to timestamp_ntz, invalidated_at timestamp_ntz, closed_by string, obs_count int, salience double"


def _open_at(c: dict, t) -> bool:
    return c["invalidated_at"] is None and (c["valid_to"] is None or c["valid_to"] > t)


def fold(assertions: list[dict], functional: set[str]) -> list[dict]:
    """Assertions (id, predicate, object, polarity, valid_from, arrived_at, confidence) in order of arrival; the rows stored."""
    rows: list[dict] = []
    by_id: dict[str, dict] = {}
    live: dict[str, list[dict]] = {}
    for a in sorted(assertions, key=lambda a: (a["arrived_at"], a["id"])):
        t, one = a["arrived_at"], a["predicate"] in functional
        if a.get("closes"):
            c = by_id.get(a["closes"])
            if c is not None and c["invalidated_at"] is None:
                if a["how"] == "retired":
                    c["invalidated_at"], c["closed_by"] = t, a["id"]
                elif c["valid_to"] is None or max(a["valid_from"], c["valid_from"]) < c["valid_to"]:
                    c["valid_to"], c["closed_by"] = max(a["valid_from"], c["valid_from"]), a["id"]
            continue
        # what is over by now stays over: arrivals only move on
        slot = live[a["predicate"]] = [c for c in live.get(a["predicate"], []) if _open_at(c, t)]
        new = {"id": a["id"], "predicate": a["predicate"], "object": a["object"], "action": "add", "valid_from": a["valid_from"], "valid_to": None, "invalidated_at": None, "closed_by": None, "obs_count": 1, "salience": 1.0, "confidence": a["confidence"]}
        if not a["predicate"] or (not a["object"] and a["polarity"] > 0):
            continue
        if a["polarity"] < 0:
            hit = [c for c in slot if _open_at(c, t) and (not a["object"] or c["object"] == a["object"])]
            for c in hit:
                c["valid_to"], c["closed_by"] = max(a["valid_from"], c["valid_from"]), a["id"]
            if hit:
                rows.append(new | {"action": "retract", "valid_to": a["valid_from"], "invalidated_at": t})
                by_id[a["id"]] = rows[-1]
            continue
        same = [c for c in slot if c["object"] == a["object"] and _open_at(c, t)]
        begun = [c for c in same if c["valid_from"] <= a["valid_from"]]
        if begun:
            c = begun[0]
            faded = 1 - min(1.0, c["salience"])
            c["obs_count"] += 1
            c["salience"] = min(CAP, c["salience"] + BUMP * (0.1 + 0.9 * faded))
            continue
        others = [c for c in slot if one and c["object"] != a["object"] and _open_at(c, t)]
        newer = [c for c in others if c["valid_from"] > a["valid_from"]] + [c for c in same if c["valid_from"] > a["valid_from"]]
        if newer:
            new["valid_to"] = min(c["valid_from"] for c in newer)
        older = [c for c in others if c["valid_from"] <= a["valid_from"] and (c["valid_to"] is None or c["valid_to"] > a["valid_from"])]
        weak = [c for c in older if a["confidence"] < AUTHORITY * c["confidence"]]
        for c in older:
            if c not in weak:
                c["valid_to"], c["closed_by"] = a["valid_from"], a["id"]
                new["action"] = "supersede"
        rows.append(new | ({"action": "dispute"} if weak else {}))
        by_id[a["id"]] = rows[-1]
        slot.append(rows[-1])
    return rows


def reconcile(assertions: DataFrame, functional: set[str]) -> DataFrame:
    """The fold over every subject."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        got = fold(frame.to_dict("records"), functional)
        out = pd.DataFrame([{k: r[k] for k in columns} for r in got], columns=columns)
        out.insert(0, "subject", key[0])
        for c in ("valid_from", "valid_to", "invalidated_at"):
            out[c] = pd.to_datetime(out[c])
        return out

    told = ["subject", "id", "predicate", "object", "polarity", "valid_from", "arrived_at", "confidence"]
    told += [c for c in ("closes", "how") if c in assertions.columns]
    return assertions.select(*told).groupBy("subject").applyInPandas(one, SCHEMA)


__all__ = ["fold", "reconcile", "F"]
