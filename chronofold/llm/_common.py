"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table; only Spark's reader touches the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local folder of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage on storage that outlives any executor; a lost executor costs only the tasks it ran. The files go with
    unmaterialize(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    # shuffle files of what is now written go once the driver's garbage is collected, which may else be long in coming
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unmaterialize(df: DataFrame) -> None:
    """Remove the files of a materialize() result that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), easy on memory.

    Arrow batches are of at most 1000 rows from now on, since whole texts may be long and a batch is held twice. When a task
    ends, what run() held is freed and goes back to the system: workers are used again by later stages.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > 1000:
        conf.set(key, "1000")

    def tidy(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most n rows, those with the least hashes of the columns by: the same rows for the same table.

    Tables much larger than n are thinned by hash first, to some 4 n rows, so that what tasks send on does not grow with their number.
    """
    h, total = F.xxhash64(*by), df.count()
    if total > 8 * n:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 4 * n / total))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *by).limit(n)


def words_col(text: Column) -> Column:
    """Words of a text, runs of anything but the code points 0x20 and 0x09 to 0x0D; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def words_of(text: str | None) -> list[bytes]:
    """The same words in Python, as bytes: bytes.split() splits at exactly these six code points."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rows_in(batches: Iterable[pa.RecordBatch], *names: str, size: int = 2000) -> Iterator[list[list[Any]]]:
    """Columns of Arrow batches as Python lists, at most size rows at a time, so that memory stays bounded."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for k in range(0, batch.num_rows, size):
            yield [c.slice(k, size).to_pylist() for c in cols]
        del batch, cols


class Bounded(dict):
    """A memo table that starts anew when it is full; what it holds never changes a result, only the time.

    Keys with a length over longest are made each time and never kept, so that entries, too, have a bounded size.
    """

    def __init__(self, make, limit: int = 200_000, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        made = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made
