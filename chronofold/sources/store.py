"""Documents kept whole and by chunk, with differences between versions; and columns encrypted or compared as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.sources.documents import chunk_diff, chunk_documents


def add_documents(existing_chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks after the update, changes): chunks of docs (id, text) replace those of the same ids; unchanged ones are recognised by hash."""
    new = chunk_documents(docs, "id", "text")
    mine = existing_chunks.join(docs.select("id").distinct(), "id", "left_semi")
    rest = existing_chunks.join(docs.select("id").distinct(), "id", "left_anti")
    return rest.unionByName(new), chunk_diff(mine, new)


def delete_documents(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """claims (with sources) without the gone chunks (id) among their sources; orphaned marks those left without any.

    Ids to delete meet single citations in an equi-join; no list of all of them is shipped.
    """
    cited = claims.select("id", F.explode("sources").alias("source")).join(gone.select(F.col("id").alias("source")).distinct(), "source")
    doomed = cited.groupBy("id").agg(F.collect_set("source").alias("doomed"))
    out = claims.join(doomed, "id", "left")
    left = F.array_except("sources", F.coalesce("doomed", F.expr("cast(array() as array<string>)")))
    return out.withColumn("orphaned", (F.size("sources") > 0) & (F.size(left) == 0)).withColumn("sources", left).drop("doomed")


def changed_since(snapshot: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys of rows that are not what a snapshot saw (for optimistic write-back), by a digest of all columns."""
    columns = [c for c in snapshot.columns if c != key]
    digest = lambda df, name: df.select(key, F.xxhash64(*columns).alias(name))
    both = digest(snapshot, "was").join(digest(current, "is"), key, "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("is"))).select(key)


def seal(column: Column, secret: Column) -> Column:
    """AES-256-GCM; the key is a binary column or literal of 32 bytes."""
    return F.aes_encrypt(column, secret, F.lit("GCM"))


def unseal(column: Column, secret: Column) -> Column:
    return F.aes_decrypt(column, secret, F.lit("GCM")).cast("string")


def page_of(df: DataFrame, order: list[Column], size: int, after: Column | None = None) -> DataFrame:
    """A page of a listing, sizes from 1 to 1000."""
    if not 1 <= size <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    return (df if after is None else df.filter(after)).orderBy(*order).limit(size)
