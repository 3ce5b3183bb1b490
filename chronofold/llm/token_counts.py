"""Token counts from an exact histogram of encoded lengths.

Each task encodes its documents and emits one count per length it met, so what is shuffled is bounded by the number of
different lengths, not of documents. From the histogram, suffix sums give for every context limit L that occurs as a
length: how many documents are at least that long, the tokens they hold, what remains of the corpus if every document is
truncated to L tokens, and the share of documents of at most that length (the quantile q is the least length whose share is q or more). Suffix sums go by two levels, over blocks of lengths and within a block, so no task sorts all
lengths. answers() reads totals, quantiles and truncated totals for given limits off the same table.

Defined results: null and empty texts have length 0; repeated rows count each; very long texts are encoded whole; an empty table
gives an empty histogram; columns other than text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._common import arrow, materialize, rows_in
from chronofold.llm.byte_bpe import codec

#: Lengths in a block. There are (longest length / WIDTH) blocks, which one window sums.
WIDTH = 4096


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens and n_docs: the exact number of documents of each encoded length."""

    def run(batches):
        encode, counts = codec(path, pattern).encode, Counter()
        for (texts,) in rows_in(batches, "text", size=500):
            counts.update(len(encode(t)) // 4 for t in texts)
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    return arrow(docs.select("text"), run, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_from and tokens_from (of documents at least so long), truncated_total (all cut to n_tokens), share_upto."""
    rows = materialize(hist.withColumn("block", F.expr(f"n_tokens DIV {WIDTH}")))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later, earlier = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1), W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = sums.select("block", F.sum("d").over(W.partitionBy()).alias("d_all"), F.coalesce(F.sum("d").over(later), none).alias("d_after"), F.coalesce(F.sum("t").over(later), none).alias("t_after"), F.coalesce(F.sum("t").over(earlier), none).alias("t_before"))
    down = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, -1)
    own = F.col("n_docs") * F.col("n_tokens")
    out = rows.join(sums, "block").withColumns({
        "docs_from": F.sum("n_docs").over(down) + F.col("d_after"),
        "tokens_from": F.sum(own).over(down) + F.col("t_after"),
        "below": F.coalesce(F.sum(own).over(up), none) + F.col("t_before"),
    })
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("below") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"), (1 - (F.col("docs_from") - F.col("n_docs")) / F.col("d_all")).alias("share_upto"))


def answers(hist: DataFrame, limits: Sequence[int], quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """question, argument and answer: total tokens and documents, quantiles of the length, truncated totals for any limits."""
    rows = materialize(suffix_sums(hist))
    total = rows.agg(F.sum("n_docs").alias("n"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    out = total.selectExpr("stack(2, 'documents', 0D, coalesce(n, 0L), 'tokens', 0D, coalesce(t, 0L)) AS (question, argument, answer)")
    cut = [F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(int(x)))).alias(f"l{k}") for k, x in enumerate(limits)]
    # the smallest length with a share q of documents at or below it: fewer than (1 - q) n documents are longer
    with_n = rows.withColumn("n", total.select("n").scalar())
    at = [F.min(F.when(F.col("docs_from") - F.col("n_docs") <= (1 - q) * F.col("n"), F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(quantiles)]
    for name, picked, values in (("truncated", cut, limits), ("quantile", at, quantiles)):
        if picked:
            cells = ", ".join(f"'{name}', {float(x)}D, {name[0].replace('t', 'l')}{k}" for k, x in enumerate(values))
            out = out.unionAll(with_n.agg(*picked).selectExpr(f"stack({len(values)}, {cells}) AS (question, argument, answer)"))
    return out
