"""Corpus pipeline: five stages over documents, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: token ids and
decoded text). run() writes each stage's rows as Parquet into the shared folder and reads them back for the next one, so a
lost executor costs tasks of one stage and not the corpus.

1. quality classifier: documents scored under 0.5 go. 2. quality rules: documents that fail the base rules, or whose host
is refused, go. 3. n-gram Jaccard join: one document of each group of near duplicates stays, that of the least doc_id.
4. benchmark decontamination: documents that hold a verified test item go. 5. byte-level BPE: token ids, and their
decoding.

Rows with null or empty texts fail the base rules of stage 2. Extra columns of documents pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import byte_bpe, decontamination, jaccard_join, quality_classifier, quality_rules
from chronofold.llm._common import materialize, read_table


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.reject(docs, model)


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedupe(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and text as decoded from the ids."""
    got = byte_bpe.encode(docs, *byte_bpe.vocabulary())
    return got.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality classifier", by_classifier),
    ("quality rules", by_rules),
    ("n-gram Jaccard join", by_similarity),
    ("benchmark decontamination", by_benchmark),
    ("byte-level BPE", to_tokens),
]

#: The classifier, the weighted index and the tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
