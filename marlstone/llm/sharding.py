"""Longest-processing-time scheduling of documents into shards.

Groups (equal texts) stay together.  Sorted by size, the largest first, each
goes to the shard with the least load, the first of several, found through a
heap.  All groups are scheduled so: the driver's heap takes the groups of one
size at once, as a number, and says how many of them each shard gets; which of
them is decided by rank, in the cluster.  So the driver holds a row for each
*size* that occurs and no row for a group: sizes are whole bytes, so there are
no more of them than the largest group has bytes, and far fewer in texts,
however many documents there are.  A group larger than a shard's share makes
its shard larger than the others; it can't be split.

A null text has no bytes and is grouped with empty ones.  Null and repeated
doc_ids are placed like others, very long texts by their size; groups of equal
size are in the order of their texts' hashes.  Columns other than doc_id and
text are ignored, whatever their names.  An empty table gives no rows.  Texts
are told apart by 64-bit hash and size: should two of them ever agree, they
stay together as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.durable import durable

#: Rows that are ranked in one sort.
SLOTS = 2048
#: Groups of one size from which on they are not taken off the heap one by one.
MANY = 64


def _filled(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` equal sizes each load gets, taken off a heap in turn.

    Shard i is taken at loads L, L + size, L + 2 size ..; the n least of all
    these, in order of load and shard, are what the heap gives.
    """
    def taken(level: int) -> list[int]:
        return [(level - load) // size + 1 if level >= load else 0 for load in loads]

    low, high = min(loads) - 1, min(loads) + size * n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(taken(middle)) <= n else (low, middle - 1)
    counts = taken(low)
    left = n - sum(counts)
    for i, load in enumerate(loads):
        if left and load + counts[i] * size == low + 1:
            counts[i] += 1
            left -= 1
    return counts


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """For each (size, number of groups): the shards that get some, and the
    rank up to which they do."""
    loads, placed = [0] * shards, {}
    for size, n in sorted(sizes, reverse=True):
        if not size:
            # what has no size leaves the least load the least
            counts = {loads.index(min(loads)): n}
        elif n > MANY:
            counts = dict(enumerate(_filled(loads, size, n)))
        else:
            heap, counts = [(load, i) for i, load in enumerate(loads)], {}
            heapq.heapify(heap)
            for _ in range(n):
                load, i = heap[0]
                counts[i] = counts.get(i, 0) + 1
                heapq.heapreplace(heap, (load + size, i))
        end, ends = 0, []
        for i, count in sorted(counts.items()):
            if count:
                loads[i] += size * count
                end += count
                ends.append((i, end))
        placed[size] = ends
    return placed


def numbered(rows: DataFrame, key: str, parts: Column, order: str, name: str) -> DataFrame:
    """``rows`` with their place in the order within ``key``, gapless from 0.

    A key is sorted in so many ``parts``, so it may have any share of the rows.
    """
    dealt = rows.withColumn("__part", F.pmod(F.col(order), parts.cast("long")))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "__part").agg(F.count("*").alias("__n")).select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__part").orderBy(order)))
    return ranked.join(starts, [key, "__part"]).select(*rows.columns, (F.col("__first") + F.col("__rank") - 1).alias(name))


def assign(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and the slot in it, gapless from 0."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = durable(docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row")))
    groups = durable(rows.groupBy("group", "size").agg(F.count("*").alias("n")).withColumn("bytes", F.col("size") * F.col("n")))
    sizes = [(x["bytes"], x["groups"], x["n"]) for x in groups.groupBy("bytes").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).collect()]
    placed = schedule(((size, n) for size, n, _ in sizes), shards)
    kind = "bytes long, parts long, ends array<struct<shard: int, end: long>>"
    table = spark.createDataFrame([(size, -(-n // SLOTS), placed[size]) for size, n, _ in sizes], kind)
    ranked = numbered(groups.join(table, "bytes"), "bytes", F.col("parts"), "group", "rank")
    shard = F.get(F.filter("ends", lambda x: x["end"] > F.col("rank")), F.lit(0))["shard"]
    homes = durable(ranked.select("group", "size", "n", shard.alias("shard")))
    counts = {x["shard"]: x["n"] for x in homes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    spread = F.array(*(F.lit(max(1, -(-counts.get(i, 0) // SLOTS))) for i in range(shards)))
    found = rows.join(homes.drop("n"), ["group", "size"])
    slots = numbered(found, "shard", F.get(spread, F.col("shard")), "row", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
