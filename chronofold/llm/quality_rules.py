"""Quality rules at the level of a document and of its host, on DataFrame functions alone.

Each document fails the base rules if it has under MIN_WORDS words, or if over half of its words stand in 3-word windows
that it repeats. Failures are counted by host (``source``), a host's failure rate is shrunk towards all hosts with a beta
prior fitted to the hosts' rates by moments, and a host whose shrunk rate exceeds MAX_HOST_RATE is refused: none of
its documents are kept. The verdict of the host is joined back to the documents.

All counting happens within a row (no exploded words, no shuffle of text); what is shuffled is one slim row per document,
and per host and task one pair of counts. A host with a third of all rows is summed before the shuffle, and the join back
is a plain equi-join that Spark broadcasts or splits by its measured size. Windows are compared by 64-bit hashes, within one text
only: a text of L words has a wrong repeat with a chance of L * L / 2^65. That is 3e-8 for a million words, and 2e-4 for any one
text among 4e10 texts of 400 words (some 100 TB).

The mean and variance of the hosts' rates are made of exact sums of whole numbers (rates in units of 1e-9), so that a verdict
does not hang on the order in which tasks end.

Defined results: a null or empty text has no words and fails; null hosts form one host; repeated rows count each; very long texts are
counted whole; a null doc_id is kept; an empty table gives an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import materialize, words_col

MIN_WORDS = 50
#: In percent of the words.
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"
#: A host is refused beyond this shrunk rate of failures.
MAX_HOST_RATE = 0.5
#: Rates are summed up in units of one part in so many.
UNITS = 1e9
#: The prior counts as so many documents at least and at most.
PRIOR = (1.0, 1000.0)
#: Refused hosts, and bytes of their names, that are broadcast at most.
MAX_BROADCAST = (200_000, 8_000_000)


def _base(df: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, n_words, the four counts and the columns to carry along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.select(
        *carry, "doc_id", "source", words_col(F.col("text")).alias("w"), lines.alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *carry, "doc_id", "source", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")).alias("h"),
    )
    # Only texts that repeat a window at all go on: their windows in order of hash, then the places of those that have an equal neighbour.
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    keep = [*carry, "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    df = df.select(*keep, F.when(repeats, F.expr("sort_array(transform(h, (x, i) -> struct(x, i)))")).alias("s"))
    df = df.select(*keep, F.when(F.col("s").isNotNull(), F.expr("""
        sort_array(transform(filter(sequence(0, size(s) - 1), i -> (i > 0 and s[i].x = get(s, i - 1).x) or (i < size(s) - 1 and s[i].x = get(s, i + 1).x)), i -> s[i].i))
    """)).alias("at"))  # fmt: skip
    # A window covers three words, of which the next one may share up to two.
    covered = F.when(F.size("at") == 1, F.lit(3)).otherwise(F.expr("aggregate(sequence(1, size(at) - 1), 3, (n, i) -> n + least(3, at[i] - at[i - 1]))"))
    return df.select(*keep, F.when(F.col("at").isNull() | (F.size("at") == 0), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def host_rates(base: DataFrame) -> DataFrame:
    """source, n_docs, n_failed and the shrunk rate of each host.

    The prior is one row, taken as a scalar subquery: mean m and variance v of the hosts' rates give it the weight
    m (1 - m) / v - 1, held within PRIOR.
    """
    hosts = base.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    units = F.round(F.col("n_failed") / F.col("n_docs") * UNITS).cast("long").cast("decimal(19,0)")
    sums = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(units).cast("double").alias("a"), F.sum(units * units).cast("double").alias("b"))
    m = F.col("a") / F.col("n") / UNITS
    prior = sums.select(m.alias("m"), (F.col("b") / F.col("n") / UNITS / UNITS - m * m).alias("v"))
    weight = F.when(F.col("v") > 1e-12, F.greatest(F.lit(PRIOR[0]), F.least(F.lit(PRIOR[1]), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(PRIOR[1]))
    prior = prior.select(F.struct("m", weight.alias("k")).alias("p"))
    hosts = hosts.withColumn("p", prior.scalar())
    return hosts.select("source", "n_docs", "n_failed", ((F.col("n_failed") + F.col("p.m") * F.col("p.k")) / (F.col("n_docs") + F.col("p.k"))).alias("host_rate"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, source and host_rate."""
    base = materialize(_base(docs).withColumn("base_failed", base_failed()))
    hosts = host_rates(base).select(F.col("source").alias("host"), "host_rate")
    out = base.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE)).alias("kept"), "source", "host_rate")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps.

    Rows and their base verdicts are written once; then failures are summed by host, and rows of refused hosts leave by an
    anti join. Refused hosts are counted and measured first: within MAX_BROADCAST they are broadcast, so no text moves; beyond it
    both sides are shuffled by host, where adaptive execution splits large hosts.
    """
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "source", "text")
    base = materialize(_base(own, "row").select("row", "source", base_failed().alias("base_failed")))
    refused = materialize(host_rates(base).filter(F.col("host_rate") > MAX_HOST_RATE).select(F.col("source").alias("host")))
    n, size = refused.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    passed = base.filter("NOT base_failed")
    if n:
        few = n <= MAX_BROADCAST[0] and size <= MAX_BROADCAST[1]
        passed = passed.join(F.broadcast(refused) if few else refused, F.col("source").eqNullSafe(F.col("host")), "left_anti")
    return passed.select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, w, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY k),
b AS (SELECT t.k, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN c USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
u AS (SELECT round(bad / n * 1e9)::HUGEINT AS x FROM h),
o AS (SELECT count(*) AS n, sum(x)::DOUBLE AS a, sum(x * x)::DOUBLE AS b FROM u),
p AS (SELECT a / n / 1e9::DOUBLE AS m, b / n / 1e9::DOUBLE / 1e9::DOUBLE - (a / n / 1e9::DOUBLE) * (a / n / 1e9::DOUBLE) AS v FROM o),
q AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM p),
hr AS (SELECT source, (bad + m * s) / (n + s) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN hr ON f.source IS NOT DISTINCT FROM hr.source
"""
