"""Exact nearest vectors, token weights, hashed embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrow import streamed

_WORD = re.compile(r"[A-Za-z0-9_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _best(query: np.ndarray, vec: np.ndarray, likeness: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties by the least vec_id."""
    order = np.lexsort((vec, -likeness, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[rank < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 65536, rows: int = 1024) -> DataFrame:
    """The ``k`` nearest of all vectors for each of a stated query set.

    ``queries``: query_id, query.  ``vectors``: vec_id, embedding; all of one
    length, without nulls, ids whole numbers.  Queries are counted and dealt by hash into blocks of
    about ``block``, each held by every worker while all vectors pass once, in
    products of a slice of queries and a batch of vectors.  A task keeps the
    best k of each query only, so that is all that is shuffled.  Vectors of
    length zero are like nothing (0).  Ties go to the least vec_id.
    """
    blocks = max(1, -(-queries.count() // block))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("likeness"), "vec_id"))

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def stacked(column: pa.Array) -> np.ndarray:
        return np.stack([np.asarray(x, np.float64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 0))

    found = None
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        held = own.select("query_id", "query").toArrow()
        ids, table = held.column("query_id").to_numpy(), unit(stacked(held.column("query").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    vec, own = part.column(0).to_numpy(), unit(stacked(part.column(1)))
                    for start in range(0, len(table), rows):
                        likeness = np.round(table[start : start + rows] @ own.T, 6) + 0.0
                        least = np.partition(likeness, -min(k, len(vec)), axis=1)[:, -min(k, len(vec))]
                        q, v = np.nonzero(likeness >= least[:, None])
                        kept = [np.concatenate(x) for x in zip(kept, (q + start, vec[v], likeness[q, v]))]
                        if len(kept[0]) > 4 * k * max(rows, len(table)):
                            best = _best(*kept, k)
                            kept = [x[best] for x in kept]
            if len(kept[0]):
                best = _best(*kept, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0][best]]), pa.array(kept[1][best]), pa.array(kept[2][best])], ["query_id", "vec_id", "likeness"])

        if len(ids):
            best = vectors.select("vec_id", "embedding").mapInArrow(run, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, likeness double")
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = vectors.select(F.lit(None).cast(kinds["query_id"]).alias("query_id"), "vec_id", F.lit(0.0).alias("likeness")).limit(0)
    return found.withColumn("place", rank).filter(F.col("place") <= k)


def once(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``top_k`` of each different query, for all that ask it."""
    keyed = queries.withColumn("__q", F.xxhash64(F.col("query").cast("array<double>")))
    different = keyed.groupBy("__q").agg(F.first("query").alias("query")).withColumnRenamed("__q", "query_id")
    found = top_k(different, vectors, k)
    return keyed.select("query_id", "__q").join(found.withColumnRenamed("query_id", "__q"), "__q").drop("__q")


def idf(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """token, df and idf = ln((N + 1) / (df + 1)) + 1."""
    n = tokens.select(doc).distinct().count()
    df = tokens.groupBy(token).agg(F.count_distinct(doc).alias("df"))
    return df.select(token, "df", (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_overlap(source: DataFrame, target: DataFrame, weights: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Of each source's token weight, the largest share one target has.

    ``source``: source_id, token, distinct, a stated set; ``target``: tokens
    (array, distinct), one row a target.  Sources are dealt by hash into blocks
    of about ``block`` tokens, each held by every worker while all targets pass
    once; a task keeps the best of each source only, so no pair is shuffled.
    """
    known = source.join(weights.select("token", "idf"), "token")
    total = known.groupBy("source_id").agg(F.sum("idf").alias("total"), F.count("*").alias("n_tokens"))
    blocks = max(1, -(-known.count() // block))
    kind = source.schema["source_id"].dataType.simpleString()
    best = None
    for i in range(blocks):
        held = known.filter(F.pmod(F.xxhash64("source_id"), F.lit(blocks)) == i).select("source_id", "token", "idf").orderBy("source_id", "token").toPandas()
        ids, at = np.unique(held["source_id"].to_numpy(), return_inverse=True)
        postings: dict[str, tuple[list, list]] = {}
        for token, place, weight in zip(held["token"], at.tolist(), held["idf"]):
            places, own = postings.setdefault(token, ([], []))
            places.append(place)
            own.append(weight)
        packed = {token: (np.array(places), np.array(own)) for token, (places, own) in postings.items()}

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, packed: dict = packed) -> Iterator[pa.RecordBatch]:
            most = np.zeros(len(ids))
            for batch in batches:
                for tokens in batch.column(0):
                    hits = [packed[t] for t in tokens.as_py() or () if t in packed]
                    if len(hits) > 1:
                        places, weight = np.concatenate([p for p, _ in hits]), np.concatenate([w for _, w in hits])
                        shared, n = np.bincount(places, weight, len(ids)), np.bincount(places, minlength=len(ids))
                        most = np.maximum(most, np.where(n > 1, shared, 0.0))
            own = np.flatnonzero(most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(most[own])], ["source_id", "shared"])

        if len(ids):
            found = target.select("tokens").mapInArrow(run, f"source_id {kind}, shared double")
            best = found if best is None else best.unionByName(found)
    if best is None:
        best = total.select("source_id", F.lit(None).cast("double").alias("shared")).limit(0)
    best = best.groupBy("source_id").agg(F.max("shared").alias("best"))
    return total.join(best, "source_id", "left").select("source_id", "n_tokens", F.round(F.coalesce(F.col("best") / F.col("total"), F.lit(0.0)), 6).alias("ratio"))


def embed(text: str, size: int = 384) -> list[float]:
    """Words and neighbours hashed by BLAKE2b, weighted by length, of unit length."""
    vector = [0.0] * size
    words = _WORD.findall(text.lower())
    slot = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=16).digest()[:4], "big") % size
    for word in words:
        vector[slot(word)] += 1.0 + len(word) / 10.0
    for a, b in zip(words, words[1:]):
        vector[slot(f"{a}:{b}")] += 0.5
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else vector


def embedded(text: Column, size: int = 384) -> Column:
    return streamed(lambda t: embed(t or "", size), "array<double>", text)
