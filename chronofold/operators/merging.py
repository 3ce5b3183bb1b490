"""Near-duplicate values of a slot: greedy clusters within a sorted neighbourhood."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronofold.functions.language import hash_embed

WINDOW = 64


def clusters(texts: list[str], threshold: float) -> list[int]:
    """Number of the cluster of each text. Texts are in order; each joins the first earlier one within WINDOW that is near enough and has the same digits."""
    vectors = np.array([hash_embed(t) for t in texts])
    numbers = [[d.lstrip("0") or "0" for d in re.findall(r"\d+", t)] for t in texts]
    out: list[int] = []
    for k in range(len(texts)):
        lo = max(0, k - WINDOW)
        near = np.flatnonzero(vectors[lo:k] @ vectors[k] >= threshold) + lo
        out.append(next((out[j] for j in near if numbers[j] == numbers[k]), k))
    return out


def merge_near(claims: DataFrame, threshold: float = 0.97) -> DataFrame:
    """id, keeper and obs_count: of rows (fact_key, id, text, obs_count, recorded_at) the one each is merged into, and what it then counts.

    Equal texts of a slot are folded by a plain aggregation first, so the greedy pass sees each text of a slot once.
    """
    from pyspark.sql import functions as F

    folded = claims.groupBy("fact_key", F.lower("text").alias("text")).agg(F.sum("obs_count").alias("n"), F.max_by("id", F.struct("obs_count", F.col("id"))).alias("keeper"), F.collect_list("id").alias("ids"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("text", ignore_index=True)
        frame["cluster"] = clusters(frame["text"].tolist(), threshold)
        frame["total"] = frame.groupby("cluster")["n"].transform("sum")
        best = frame.sort_values(["n", "keeper"], ascending=[False, True]).drop_duplicates("cluster").set_index("cluster")["keeper"]
        frame["keeper"] = frame["cluster"].map(best)
        return frame[["ids", "keeper", "total"]]

    got = folded.groupBy("fact_key").applyInPandas(one, "ids array<string>, keeper string, total long")
    return got.select(F.explode("ids").alias("id"), "keeper", F.col("total").alias("obs_count"))
