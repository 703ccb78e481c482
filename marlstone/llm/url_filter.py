"""URL rules as sort-merge range joins with sweeps over nested intervals.

A host is keyed by its labels from the last to the first ("org.example."), so
the hosts below a rule's host are one interval of keys that starts at the
rule's; paths that start with a rule's path are one interval of the paths of
its host.  Intervals of prefixes nest or are apart.  Two sweeps follow each
other: over hosts, where each url finds the rule hosts that are open at its
key, and over (rule host, path), where it finds the rules open at its path.
In a sweep, starts of intervals and urls are sorted by key over range
partitions; the last start passed carries the stack of intervals that are
nested around it, of which those that really begin the url's key are open.  A
partition starts with the stack that the partitions before it left.  Stacks
are as deep as rules nest (labels of a host, paths that begin each other),
however many rules a host has.  Urls of one host spread over partitions by
their path and a salt, so a host may hold any share.

Null urls, and those without "://", have an empty host and path and fit no rule
but one of an empty host.  Repeated rows and ids are judged each, page_id may
be null, long urls are taken whole; further columns, whatever their names, are
ignored.  Empty pages give no rows.  Equal rules count once, of those that
differ in the verdict the first verdict in order; rules with a null host are
ignored, a null path is an empty one, an empty host that of all hosts; where
equally long rules fit, the one of the longer host wins.  An empty rules table
leaves all to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a range partition, and the most that is broadcast of carried stacks.
ROWS, MOST_CARRIED = 1 << 20, 1 << 25


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot; the empty host's key is empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _hosts_open(rules: DataFrame) -> DataFrame:
    """key of each rule host and ``stack``, the rule hosts it lies below."""
    hosts = rules.select("key").distinct()
    labels = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("."))))
    chain = hosts.select("key", F.explode(F.array_distinct(above)).alias("up"))
    found = chain.join(hosts.withColumnRenamed("key", "up"), "up").groupBy("key").agg(F.collect_set("up").alias("stack"))
    return found.select(F.lit("").alias("anchor"), "key", "stack")


def _rules_open(rules: DataFrame) -> DataFrame:
    """(anchor, key) of each rule and ``stack``, the rules it is nested in.

    Its beginnings are looked up by their hash, those only that are as long as
    some rule of the host; a stack holds paths that begin each other.
    """
    lengths = rules.select(F.col("key").alias("anchor"), F.length("rule_path").alias("n")).distinct()
    inner = rules.select(F.col("key").alias("anchor"), F.col("rule_path").alias("path"))
    heads = inner.join(lengths, "anchor").filter(F.col("n") <= F.length("path")).select("anchor", "path", F.substring("path", F.lit(1), F.col("n")).alias("head"))
    rule = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", F.col("rule_path").alias("key"), "verdict", F.col("key").alias("anchor"))
    outer = rules.select(F.col("key").alias("anchor"), F.col("rule_path").alias("head"), rule.alias("found"))
    return heads.join(outer, ["anchor", "head"]).groupBy("anchor", F.col("path").alias("key")).agg(F.collect_list("found").alias("stack"))


def sweep(points: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """``points`` (anchor, key, row, then) with ``open``, the stack of the last
    start at or before each, over all range partitions; null before the first."""
    kind = starts.schema["stack"].dataType
    events = points.select("anchor", "key", "row", "then", F.lit(None).cast(kind).alias("stack"), F.lit(1).alias("is_point")).unionByName(
        starts.select("anchor", "key", F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("then"), "stack", F.lit(0).alias("is_point"))
    )
    order = ["anchor", "key", "is_point", "salt"]
    salted = events.withColumn("salt", F.xxhash64("row"))
    dealt = durable(salted.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # what is open where a partition starts: one row a partition
    ends = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("is_point") == 0, F.struct("anchor", "key"))).alias("left"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(ends.select("part", F.last("left", ignorenulls=True).over(before).alias("carried")))
    held = carried.agg(F.sum(F.length(F.to_json(F.struct("carried"))))).first()[0] or 0
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(along)).filter("is_point = 1")
    swept = swept.join(F.broadcast(carried) if held <= MOST_CARRIED else carried, "part", "left")
    return swept.select("anchor", "key", "row", "then", F.coalesce("open", "carried").alias("open"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    urls = durable(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row")))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), urls.count() // ROWS)
    own = rules.select(F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").filter("rule_host is not null").withColumn("key", host_key(F.col("rule_host")))
    own = own.groupBy("key", "rule_host", "rule_path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("rule_host", "rule_path"))

    by_host = sweep(urls.select(F.lit("").alias("anchor"), host_key(F.col("host")).alias("key"), "row", F.col("path").alias("then")), _hosts_open(own), n)
    at = by_host.select("row", "then", F.explode(F.filter("open", lambda up: F.col("key").startswith(up))).alias("anchor"))
    anchors = at.select("anchor", F.col("then").alias("key"), "row", F.lit("").alias("then"))
    by_path = sweep(anchors, _rules_open(own), n)
    # the last start may be another host's
    fits = F.filter("open", lambda r: (r["anchor"] == F.col("anchor")) & F.col("key").startswith(r["key"]))
    best = by_path.select("row", F.array_max(fits).alias("best")).filter("best is not null").groupBy("row").agg(F.max("best").alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
