"""URL filters: a sort-merge range join of urls and host/path rules, on DataFrame functions alone.

A host becomes a canonical key of its labels in reverse, each followed by a dot (``blog.example.net`` ->
``net.example.blog.``). A rule's host then is a prefix, and so an interval of keys ``[net., net/)``; intervals nest or
are apart. A sorted sweep over the rules keeps the stack of active nested intervals and notes it at each boundary. The stack has a slot
for each number of labels: a slot holds the last interval of that depth to have opened, and is active where its key is a prefix of the
boundary's. So the sweep is one window in sorted order, in time linear in the rules.

Urls and boundaries are then dealt out together by ranges of their keys (a hash of the url splits a host that holds a third of all
rows over several ranges), and swept range by range: each url gets the stack of the last boundary at or before its key. What
a range needs from before its first boundary is carried in: the last stack of each range, one row a range. Of the rules on the stack the
one wins whose path is a prefix of the url's and whose text is longest. Rules are never copied, whatever their number.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default verdict; repeated
rows are judged each on its own; very long urls are judged whole; of rules with equal text ``block`` wins; rules without a host fit nothing;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronofold.llm._common import materialize

#: Rules by contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


_STACK = "array<struct<rule:string,verdict:string,rpath:string>>"


def boundaries(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """key and stack: one row per boundary of the rules' intervals, with the rules active from there on."""
    given = spark.createDataFrame([(v, r, *r.partition("/")[::2]) for v, r in rules] or [("", "", "", "")], "verdict string, rule string, rhost string, rpath string")
    given = given.filter(F.col("rhost") != "").select(host_key(F.col("rhost")).alias("lo"), F.struct("rule", "verdict", F.concat(F.lit("/"), "rpath").alias("rpath")).alias("r"))
    hosts = given.groupBy("lo").agg(F.sort_array(F.collect_list("r")).alias("own")).withColumn("depth", F.size(F.split("lo", r"\.")) - 1)
    depths = sorted({r.partition("/")[0].count(".") + 1 for _, r in rules if r.partition("/")[0]})
    sorted_sweep = W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    slots = hosts.select("lo", "own", "depth", *(F.last(F.when(F.col("depth") == d, F.struct("lo", "own")), ignorenulls=True).over(sorted_sweep).alias(f"slot{d}") for d in depths))
    none = F.expr(f"cast(array() as {_STACK})")
    active = [F.when((F.col("depth") > d) & F.col("lo").startswith(F.col(f"slot{d}.lo")), F.col(f"slot{d}.own")).otherwise(none) for d in depths]
    rows = slots.select("lo", "own", (F.concat(*active) if active else none).alias("outer"))
    # a key's prefix ends with a dot; the next byte is a slash, so the interval's end is the key with that last byte raised
    return rows.select(F.explode(F.array(
        F.struct(F.col("lo").alias("key"), F.concat("outer", "own").alias("stack")),
        F.struct(F.concat(F.expr("substr(lo, 1, length(lo) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("stack")),
    )).alias("b")).select("b.*")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of each page; see the module's docstring."""
    spark = pages.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("deal"))
    urls = urls.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), "deal", F.lit(None).cast(_STACK).alias("stack"), F.lit(True).alias("is_url"))
    marks = boundaries(spark, rules).withColumn("is_url", F.lit(False))
    both = urls.unionByName(marks, allowMissingColumns=True).repartitionByRange(ranges, "key", "is_url", "deal")
    # written, so that a lost executor cannot deal anew, by other ranges, what others have read already
    dealt = materialize(both.select("*", F.spark_partition_id().alias("range")))
    last = dealt.filter("NOT is_url").groupBy("range").agg(F.max_by("stack", "key").alias("last"))
    carried = spark.range(ranges).select(F.col("id").cast("int").alias("range")).join(last, "range", "left")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))  # one row for each range
    sweep = W.partitionBy("range").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, 0)
    merged = dealt.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url")
    merged = merged.join(carried, "range", "left").withColumn("active", F.coalesce("active", "carried", F.expr(f"cast(array() as {_STACK})")))
    fits = F.filter("active", lambda r: F.col("path").startswith(r["rpath"]))
    ranked = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return merged.withColumn("won", ranked).select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH r(verdict, rule, rhost, rpath) AS (VALUES ('block','net/','net','/'), ('allow','example.net/en/','example.net','/en/'),
  ('block','example.com/de/','example.com','/de/'), ('allow','org/fr/','org','/fr/')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.k, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN r
  ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""
