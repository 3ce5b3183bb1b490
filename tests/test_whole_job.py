"""Queries and operators cover the whole of their input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from chronofold.functions.language import hash_embed
from chronofold.operators.merging import WINDOW, merge_near
from chronofold.plans import catalog
from chronofold.sources.projections import claims_ev


def merged_by_hand(rows: list[tuple], threshold: float) -> set[tuple]:
    """What merge_near says of itself, pair by pair: (id, keeper, obs_count)."""
    out = set()
    for key in {r[0] for r in rows}:
        texts: dict[str, list] = {}
        for _, id_, text, n, _ in (r for r in rows if r[0] == key):
            texts.setdefault(text.lower(), []).append((n, id_))
        order = sorted(texts)
        vector, digits = {t: hash_embed(t) for t in order}, {t: re.findall(r"\d+", t) for t in order}
        cluster: dict[str, str] = {}
        for k, t in enumerate(order):
            near = (o for o in order[max(0, k - WINDOW) : k] if np.dot(vector[o], vector[t]) >= threshold and digits[o] == digits[t])
            cluster[t] = next((cluster[o] for o in near), t)
        for head in set(cluster.values()):
            members = [t for t in order if cluster[t] == head]
            ranked = sorted((-sum(n for n, _ in texts[t]), max(texts[t])[1]) for t in members)
            out |= {(i, ranked[0][1], -sum(n for n, _ in ranked)) for t in members for _, i in texts[t]}
    return out


def test_near_but_unequal_texts_merge_as_by_hand(spark):
    long = "the quarterly report of the northern office was sent to every member of the board on time"
    rows = [("a", "a1", f"{long} in room 12", 1, 0), ("a", "a2", f"{long} in room 12.", 4, 0), ("a", "a3", f"{long} in room 13", 2, 0), ("a", "a4", "something else", 1, 0), ("a", "a5", f"{long} IN room 12", 2, 0)]
    rows += [("b", "b1", f"{long} in room 12", 3, 0), ("b", "b2", "entirely different words stand here", 1, 0)]
    # more texts of one slot than a window holds, the first and last of which are near each other
    rows += [("c", f"c{k:03}", f"the same start word{k:03}x and nothing else at all", 1 + k % 3, 0) for k in range(WINDOW + 30)]
    rows += [("d", "d1", f"{long} aa", 1, 0), *[("d", f"d{k:03}", f"{long} {chr(97 + k % 26)}{chr(98 + k // 26)} {'filler ' * (k % 9)}", 1 + k % 2, 0) for k in range(WINDOW + 30)], ("d", "d9", f"{long} zz", 1, 0)]
    claims = spark.createDataFrame(rows, "fact_key string, id string, text string, obs_count int, recorded_at int")
    for threshold in (0.97, 0.8):
        got = {(r.id, r.keeper, r.obs_count) for r in merge_near(claims, threshold).collect()}
        assert got == merged_by_hand(rows, threshold)
        assert {x[1] for x in got if x[0] in ("a1", "a2", "a5")} == {"a2"}
        assert ("a3", "a3", 2) in got and ("b1", "b1", 3) in got


def test_near_dup_merge_takes_every_claim_and_keeps_slots_apart(spark, sf):
    c = claims_ev(spark, sf).select("id", "fact_key", "event_id").collect()
    slot = {r.id: r.fact_key for r in c}
    got = catalog.queries()["near_dup_merge"](spark, sf).collect()
    assert Counter(r.id for r in got) == Counter(list(slot))
    assert all(slot[r.id] == slot[r.keeper] for r in got)
    kept = {(r.keeper, r.obs_count) for r in got}
    assert len(kept) == len({k for k, _ in kept}) and sum(n for _, n in kept) == sum(1 + r.event_id % 3 for r in c)


def rows_of_sql(sf: str, sql: str) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("conversations", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_pending_extraction_is_the_whole_gate(spark, sf):
    got = sorted((r.id,) for r in catalog.queries()["pending_extraction"](spark, sf).collect())
    sql = f"SELECT 'ep_' || conv_id || '_' || turn FROM ({catalog.oracle_sql()['salience_gate']}) WHERE reason = 'has_declarative' AND conv_id % 3 <> 0"
    assert got == rows_of_sql(sf, sql)
    short = rows_of_sql(sf, "SELECT 'ep_' || conv_id || '_' || turn FROM conversations WHERE length(text) <= 200")
    assert set(got) & set(short)


def test_links_of_covers_every_part_and_supplier(spark, sf):
    got = sorted((r.id, r.other, r.relation, r.outgoing) for r in catalog.queries()["links_of"](spark, sf).collect())
    links = "SELECT DISTINCT l_partkey AS a, l_suppkey AS b, CASE WHEN l_quantity > 25 THEN 'extends' ELSE 'derives' END AS r FROM lineitem"
    assert got == rows_of_sql(sf, f"SELECT a, b, r, true FROM ({links}) UNION ALL SELECT b, a, r, false FROM ({links}) WHERE a <> b")


def test_term_stats_keeps_rare_terms(spark, sf):
    got = {r.term: (r.cf, r.df) for r in catalog.queries()["term_stats"](spark, sf).collect()}
    cf, df = Counter(), Counter()
    for (text,) in rows_of_sql(sf, "SELECT text FROM documents WHERE text IS NOT NULL"):
        terms = re.findall(r"[a-z0-9]{2,}", "".join(c if c.isascii() else " " for c in text.lower()))
        cf.update(terms)
        df.update(set(terms))
    assert got == {t: (cf[t], df[t]) for t in cf}
    assert min(df.values()) == 1


def test_any_value_can_be_the_floor(spark):
    from chronofold.plans.search import R_floor

    for best in (437, 1013):
        pairs = [(x, int(x >= best)) for x in (1, 90, 400, 431, 437, 450, 999, 1013, 1050, 2000)]
        acc = {x: sum((n >= x) == (q == 1) for n, q in pairs) / len(pairs) for x, _ in pairs}
        want = min(acc, key=lambda x: (-round(acc[x], 9), x))
        by_x = spark.createDataFrame([(x, q, 1 - q) for x, q in pairs], "x long, pos long, neg long")
        got = R_floor(by_x).collect()[0]
        assert (got.threshold, got.accuracy) == (want, round(acc[want], 6)) == (best, 1.0)
