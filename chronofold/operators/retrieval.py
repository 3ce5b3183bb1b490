"""Lexical, vector and hybrid retrieval for batches of queries.

The corpus side is scanned once whatever the number of queries. Candidate lists are cut per query with
row_number() <= k, which Spark turns into a per-partition top-k before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronofold.functions import scoring as S
from chronofold.functions.text import ascii_tokens, query_terms, tokens

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def postings(docs: DataFrame, id_col: str, text_col: str, tokenize=tokens) -> DataFrame:
    """id, term, tf, dl. Terms are counted within the row (sorted, then run lengths), so building postings shuffles nothing."""
    rows = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("t"))
    rows = rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, tokenize=tokens, terms=query_terms, among: Column | None = None) -> DataFrame:
    """qid, id, bm25 (rounded to 6 places) and rank of each query's k best documents, exactly.

    docs: id, text. queries: qid (once each), text. among: which documents may be found; statistics cover all of them. Queries are a stated
    set, gathered in blocks. For each block one pass counts, in the tasks, the documents that hold each of its words, and a second scores
    every document whole where it is read: a task keeps the k best of each query and emits them once. So what is shuffled is words x tasks
    and queries x tasks x k; no posting and no list of query-document pairs is. Documents without id count in the statistics and are not found.
    """
    spark = docs.sparkSession
    kinds = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(docs.schema["id"].dataType)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, bm25 double"
    asked = queries.select("qid", F.array_distinct(terms(F.col("text"), tokenize)).alias("t")).orderBy("qid")
    rows = docs.select("id", tokenize(F.col("text")).alias("t"), F.coalesce(F.lit(True) if among is None else among, F.lit(False)).alias("own"))
    parts = []
    for block in _blocks(asked, QUERY_BLOCK):
        words = sorted({t for r in block for t in r.t or ()})
        if not words:
            continue
        shipped = spark.sparkContext.broadcast((words, _queries_of(words, [r.t or () for r in block]), [r.qid for r in block]))
        counts = {r.word: r.n for r in rows.select("t").mapInArrow(lambda batches, shipped=shipped: _count(batches, shipped.value[0]), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        n, known, length = (counts.get(x, 0) for x in (ALL, KNOWN, LENGTH))
        d = np.array([counts.get(w, 0) for w in range(len(words))], np.float64)
        idf = spark.sparkContext.broadcast((np.maximum(np.log((n - d + 0.5) / (d + 0.5)), LEAST_IDF), length / known if known and length else 1.0))
        parts.append(rows.filter("own AND id IS NOT NULL").select("id", "t").mapInArrow(lambda batches, shipped=shipped, idf=idf: _score(batches, *shipped.value, *idf.value, k, kinds), schema))
    return top(reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema), "bm25", k)


#: Marks among the counts of words: all documents, those with a text, and their length in words.
ALL, KNOWN, LENGTH = -1, -2, -3


def _queries_of(words: list[str], asked: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries that hold each word, one word after the other, and where those of each word start."""
    code = {w: k for k, w in enumerate(words)}
    pairs = sorted((code[t], nth) for nth, ts in enumerate(asked) for t in ts)
    return np.array([nth for _, nth in pairs], np.int64), np.searchsorted([w for w, _ in pairs], np.arange(len(words) + 1))


def _found(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of all rows; row, word and number of times of each asked word in them."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    pairs, times = np.unique(row[code >= 0] * len(words) + code[code >= 0], return_counts=True)
    return lengths, pairs // len(words), pairs % len(words), times


def _count(batches, words):
    """Documents with each word, over a task."""
    words = pa.array(words, pa.string())
    held, n, known, length = np.zeros(len(words), np.int64), 0, 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            lists = batch.column(0).slice(a, ROWS)
            lengths, _, word, _ = _found(lists, words)
            held += np.bincount(word, minlength=len(words))
            n, known, length = n + len(lists), known + len(lists) - lists.null_count, length + int(lengths.sum())
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"word": pa.array([*some, ALL, KNOWN, LENGTH], pa.int32()), "n": pa.array([*held[some], n, known, length], pa.int64())})


def _score(batches, words, queries_of, qids, idf, mean, k, kinds):
    """The k best documents of each query, over a task."""
    words, (query, start) = pa.array(words, pa.string()), queries_of
    best = _Best(len(qids), k)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            ids = np.array(batch.column(0).slice(a, ROWS).to_pylist())
            lengths, row, word, times = _found(batch.column(1).slice(a, ROWS), words)
            part = idf[word] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[row] / mean))
            fan = start[word + 1] - start[word]
            nth = np.repeat(start[word] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            sums = np.bincount(query[nth] * len(ids) + np.repeat(row, fan), np.repeat(part, fan), len(qids) * len(ids)).reshape(len(qids), len(ids))
            best.take(np.where(sums > 0, np.round(sums, 6), -np.inf), ids)
    at, ids, scores = best.all()
    yield pa.RecordBatch.from_pydict({"qid": pa.array([qids[x] for x in at], kinds[0]), "id": pa.array(ids, kinds[1]), "bm25": pa.array(scores, pa.float64())})


def top(scored: DataFrame, score: str, k: int | None) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(score), "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def all_tokens(text: Column, tokenize) -> Column:
    return tokenize(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or vectors of different widths: such a pair matches nothing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


#: Query vectors in one block, which is what is replicated, and vectors held against it at once.
QUERY_BLOCK, ROWS = 4096, 512


class _Best:
    """The k best (score, id) of each query so far; of equal scores the lesser id. Scores of -inf are none."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.least = k, [None] * n, np.full(n, -np.inf)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        # only rows that reach the last place can change anything; after some batches these are few
        reach = (scores >= self.least[:, None]) & np.isfinite(scores)
        for a in np.flatnonzero(reach.any(axis=1)):
            s, i = scores[a][reach[a]], ids[reach[a]]
            if self.held[a] is not None:
                s, i = np.concatenate([self.held[a][0], s]), np.concatenate([self.held[a][1], i])
            order = np.lexsort((np.unique(i, return_inverse=True)[1], -s))[: self.k]
            self.held[a] = s[order], i[order]
            if len(order) == self.k:
                self.least[a] = s[order[-1]]

    def all(self) -> tuple[list[int], list, list[float]]:
        """Number of the query, id and score of all that are held."""
        some = [(a, h) for a, h in enumerate(self.held) if h is not None]
        return [a for a, h in some for _ in h[0]], [i for _, h in some for i in h[1].tolist()], [x for _, h in some for x in h[0].tolist()]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """qid, id, cosine (6 places) and rank of the k nearest vectors, exactly.

    vectors: id, v. queries: qid, v. Queries are a stated set: they are gathered in blocks, and each block is held against
    all vectors by matrix products in the tasks that read them. A task keeps the k best of each query and emits them once, so what is
    shuffled is queries x tasks x k, and no list of all pairs ever exists.
    """
    spark = vectors.sparkSession
    schema, parts = "qid long, id long, cosine double", []
    for block in _blocks(queries.select("qid", "v").orderBy("qid"), QUERY_BLOCK):
        widths = {len(r.v) for r in block if r.v is not None}
        for width in sorted(widths):
            own = [r for r in block if r.v is not None and len(r.v) == width]
            q = np.array([r.v for r in own], np.float64).reshape(len(own), width)
            norms = np.linalg.norm(q, axis=1)
            shipped = spark.sparkContext.broadcast((np.array([r.qid for r in own])[norms > 0], q[norms > 0] / norms[norms > 0][:, None], width))

            def run(batches, shipped=shipped):
                ids, q, width = shipped.value
                best = _Best(len(ids), k)
                for batch in batches:
                    for a in range(0, batch.num_rows, ROWS):
                        rows = [(i, v) for i, v in zip(batch.column(0).slice(a, ROWS).to_pylist(), batch.column(1).slice(a, ROWS).to_pylist(), strict=True) if v is not None and i is not None and len(v) == width]
                        if rows:
                            m = np.array([v for _, v in rows], np.float64)
                            n = np.linalg.norm(m, axis=1)
                            sims = np.round((q @ m.T) / np.where(n == 0, 1, n), 6)
                            sims[:, n == 0] = -np.inf
                            if least is not None:
                                sims[sims < least] = -np.inf
                            best.take(sims, np.array([i for i, _ in rows]))
                at, found, scores = best.all()
                yield pa.RecordBatch.from_pydict({"qid": pa.array(ids[at] if at else [], pa.int64()), "id": pa.array(found, pa.int64()), "cosine": pa.array(scores, pa.float64())})

            parts.append(vectors.select("id", "v").mapInArrow(run, schema))
    return top(reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema), "cosine", k)


def _blocks(rows: DataFrame, size: int):
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def fuse(legs: list[tuple[DataFrame, float]]) -> DataFrame:
    """qid, id and fused score of ranked lists (qid, id, rank) with weights; a list of weight 0 takes no part."""
    parts = [df.select("qid", "id", S.rrf(F.col("rank"), w).alias("part")) for df, w in legs if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("fused"))


def slot_cap(results: DataFrame, cap: int = 2) -> DataFrame:
    """Reorders each query's results (qid, id, slot, score): up to cap of a slot stay in the head, the overflow follows, scores of 0 come last. Drops nothing."""
    by_slot = W.partitionBy("qid", "slot").orderBy(F.desc("score"), "id")
    rows = results.withColumn("nth", F.row_number().over(by_slot))
    bucket = F.when(F.col("score") <= 0, 2).when(F.col("nth") <= cap, 0).otherwise(1)
    rows = rows.withColumn("bucket", bucket)
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("bucket", F.desc("score"), "id"))).drop("nth", "bucket")


def hybrid(vector: DataFrame, lexical: DataFrame, n_terms: DataFrame, facts: DataFrame, k: int, pool: int, w_vector: float = 1.0, w_lexical: float = 1.0) -> DataFrame:
    """qid, id, score and pos. vector: qid, id, cosine, rank; lexical: qid, id, bm25, rank; n_terms: qid, n; facts: id, recency, confidence, salience.

    Fusion only picks the pool of candidates; the score is absolute: the weighted mean of the legs' relevance, times the fact's
    quality. A leg is active for a query if it found anything for it; a candidate it did not find then counts as 0.
    """
    null = F.lit(None).cast("double")
    legs = [df.select("qid", "id", (S.rrf(F.col("rank"), w) if w else F.lit(0.0)).alias("part"), (F.col("cosine") if name == "v" else null).alias("cosine"), (F.col("bm25") if name == "l" else null).alias("bm25")) for df, w, name in ((vector, w_vector, "v"), (lexical, w_lexical, "l")) if w]
    # one pass over each leg: candidates are put together by union and aggregation, not by joining the legs with themselves
    rows = reduce(DataFrame.unionAll, legs).groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("fused"), F.max("cosine").alias("cosine"), F.max("bm25").alias("bm25"))
    every = W.partitionBy("qid")
    rows = rows.withColumn("v_on", F.max("cosine").over(every).isNotNull()).withColumn("l_on", F.max("bm25").over(every).isNotNull())
    rows = top(rows, "fused", pool).join(n_terms, "qid", "left").join(facts, "id")
    weighed = [(S.vector_relevance(F.col("cosine")), F.col("v_on"), w_vector), (S.lexical_relevance(F.col("bm25"), F.col("n")), F.col("l_on"), w_lexical)]
    score = S.score(S.evidence(weighed), S.quality(F.col("recency"), F.col("confidence"), F.col("salience")))
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("pos") <= k).select("qid", "id", "score", "pos")


def coverage(found: Column, terms: Column) -> Column:
    """Share of the query's terms that a text holds."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, found)) / F.size(terms)).otherwise(0.0)


__all__ = ["all_tokens", "ascii_tokens", "bm25", "cosine", "coverage", "dot", "fuse", "hybrid", "postings", "slot_cap", "top", "vector_topk"]
