"""Bounded walks over edges, breadth first: one join a level, cut to a beam before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOP_DAMPING, BEAM, PER_RELATION = 0.75, 64, 2


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions: node, other, predicate, backward, strength."""
    out = edges.select(F.col("src").alias("node"), F.col("tgt").alias("other"), "predicate", F.lit(False).alias("backward"), F.col("confidence").alias("strength"))
    back = edges.select(F.col("tgt").alias("node"), F.col("src").alias("other"), "predicate", F.lit(True).alias("backward"), F.col("confidence").alias("strength"))
    return out.unionAll(back)


def walk(edges: DataFrame, seeds: DataFrame, depth: int, beam: int | None = BEAM, per_relation: int | None = PER_RELATION, predicates: list[str] | None = None) -> DataFrame:
    """Simple paths of 1 to depth hops from each seed (column seed): seed, nodes, predicates, backward, score, hops.

    The first hop is not damped. Of a level's paths per seed the best `beam` go on; of those that leave the same node by the same
    relation in the same direction, the best `per_relation` come before all others (they are demoted, not dropped, before the cut).
    """
    steps = both_ways(edges)
    if predicates is not None:
        steps = steps.filter(F.col("predicate").isin(predicates))
    front = seeds.select("seed", F.array("seed").alias("nodes"), F.expr("cast(array() as array<string>)").alias("predicates"), F.expr("cast(array() as array<boolean>)").alias("directions"), F.lit(1.0).alias("score"), F.col("seed").alias("node"))
    out = None
    for hop in range(depth):
        damp = 1.0 if hop == 0 else HOP_DAMPING
        nxt = front.join(steps, "node").filter(~F.array_contains("nodes", F.col("other")))
        nxt = nxt.select(
            "seed", F.concat("nodes", F.array("other")).alias("nodes"), F.concat("predicates", F.array("predicate")).alias("predicates"),
            F.concat("directions", F.array("backward")).alias("directions"), (F.col("score") * F.col("strength") * damp).alias("score"), F.col("other").alias("node"), F.col("node").alias("_from"), "predicate", "backward",
        )
        if beam is not None:
            order = [F.desc(F.round("score", 9)), F.col("nodes"), F.col("predicates")]
            late = F.lit(False)
            if per_relation is not None:
                late = F.row_number().over(W.partitionBy("seed", "_from", "predicate", "backward").orderBy(*order)) > per_relation
            nxt = nxt.withColumn("_late", late)
            nxt = nxt.withColumn("_pos", F.row_number().over(W.partitionBy("seed").orderBy("_late", *order))).filter(F.col("_pos") <= beam).drop("_late", "_pos")
        front = nxt.select("seed", "nodes", "predicates", "directions", "score", "node")
        level = front.withColumn("hops", F.lit(hop + 1))
        out = level if out is None else out.unionAll(level)
    return out


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hops: nodes within depth hops, at their least distance. Only the newly found go on to the next level."""
    steps = both_ways(edges).select("node", "other").distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        nxt = front.join(steps, "node").select("seed", F.col("other").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = nxt.withColumn("hops", F.lit(hop))
        seen = seen.unionAll(front)
    return seen.filter("hops > 0")


def spread(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and score: the best path to it from any seed of its group (columns qid, seed)."""
    paths = walk(edges, seeds.select("seed").distinct(), depth, beam=None)
    rows = seeds.join(paths, "seed").select("qid", F.element_at("nodes", -1).alias("node"), "score")
    return rows.groupBy("qid", "node").agg(F.round(F.max("score"), 6).alias("score"))


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int, k: int = 3) -> DataFrame:
    """source, target, pos, nodes, score of the k best simple paths. Walked from both ends is not needed at these depths: arrived paths end."""
    got = walk(edges, pairs.select(F.col("source").alias("seed")).distinct(), depth, beam=None)
    rows = got.join(pairs, (F.col("seed") == F.col("source")) & (F.element_at("nodes", -1) == F.col("target"))).filter("source <> target")
    w = W.partitionBy("source", "target").orderBy(F.desc(F.round("score", 9)), "nodes", "predicates")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("source", "target", "pos", F.array_join("nodes", ">").alias("path"), F.round("score", 6).alias("score"))


def render(nodes, predicates, directions):
    """A -p-> B <-q- C."""
    hops = F.transform(F.arrays_zip(F.slice(nodes, 2, 1000).alias("n"), predicates.alias("p"), directions.alias("d")), lambda x: F.when(x["d"], F.concat(F.lit(" <-"), x["p"], F.lit("- "), x["n"])).otherwise(F.concat(F.lit(" -"), x["p"], F.lit("-> "), x["n"])))
    return F.concat(nodes[0], F.array_join(hops, ""))


def join_rate(claims: DataFrame) -> DataFrame:
    """Share of edges whose end is another edge's beginning: whether walking pays at all."""
    subjects = claims.select(F.col("src").alias("tgt")).distinct()
    n = claims.agg(F.count(F.lit(1)).alias("n"))
    hit = claims.join(subjects, "tgt", "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    return hit.withColumn("n", n.scalar()).select("hit", "n", F.round(F.col("hit") / F.col("n"), 6).alias("rate"))


def edge_keys(nodes, predicates, directions):
    """The edges of a path as stored, whichever way they were walked: source, predicate and target."""
    hops = F.arrays_zip(F.slice(nodes, 1, F.size(predicates)).alias("a"), F.slice(nodes, 2, F.size(predicates)).alias("b"), predicates.alias("p"), directions.alias("d"))
    return F.transform(hops, lambda x: F.when(x["d"], F.concat_ws("|", x["b"], x["p"], x["a"])).otherwise(F.concat_ws("|", x["a"], x["p"], x["b"])))


def signature(nodes, keys):
    """A path's identity by content: where it starts, and its edges."""
    return F.concat_ws("\x1f", nodes[0], keys)


def undirected(nodes, keys):
    """The identity that a path and its mirror share: the lesser of both readings."""
    return F.least(signature(nodes, keys), F.concat_ws("\x1f", F.element_at(nodes, -1), F.reverse(keys)))


def gated(edges: DataFrame, seeds: DataFrame, depth: int, least: float = 0.0, **how) -> DataFrame:
    """A walk, or no paths at all over a store whose edges do not join (join_rate at or under `least`): walking could find nothing but first hops."""
    if (join_rate(edges).first().rate or 0.0) <= least:
        return walk(edges, seeds, 1, **how).limit(0)
    return walk(edges, seeds, depth, **how)
