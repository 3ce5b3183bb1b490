"""Routing of questions, and the gate before walks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronofold.functions import routing as Q
from chronofold.operators import graph as G


def test_roles_and_derived_relations(spark):
    rows = [("What did you recommend for the trip?", "user", False), ("You recommended a hotel, which one?", "assistant", False), ("Remind me what you said", "assistant", False), ("youtold me nothing", "user", False), ("Who is Marie's Father-in-law?", "user", True), ("", "user", False), (None, "user", False)]
    got = spark.createDataFrame(rows, "q string, role string, chain boolean").select("role", "chain", Q.routed_role(F.col("q")).alias("r"), Q.names_derived(F.col("q"), ["father-in-law", "uncle"]).alias("c")).collect()
    assert all((r.r, r.c) == (r.role, r.chain) for r in got)
    with pytest.raises(ValueError):
        Q.leg_weight(F.lit("open"), "smell")


def test_walks_only_where_edges_join(spark):
    schema = "src string, predicate string, tgt string, confidence double"
    apart = spark.createDataFrame([("a", "p", "b", 1.0), ("c", "p", "d", 1.0)], schema)
    chain = spark.createDataFrame([("a", "p", "b", 1.0), ("b", "q", "c", 1.0)], schema)
    seeds = spark.createDataFrame([("a",), ("c",)], "seed string")
    assert G.gated(apart, seeds, 2).count() == 0
    paths = G.gated(chain, seeds, 2).withColumn("keys", G.edge_keys(F.col("nodes"), F.col("predicates"), F.col("directions")))
    got = paths.select(G.signature(F.col("nodes"), F.col("keys")).alias("s"), G.undirected(F.col("nodes"), F.col("keys")).alias("u"), "hops").filter("hops = 2").collect()
    assert len({r.s for r in got}) == 2 and len({r.u for r in got}) == 1
