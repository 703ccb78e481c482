"""One document of each group of near copies, by SimHash and exact Jaccard of shingles.

Two documents are near copies if their sets of five-word shingles have a
Jaccard similarity of at least NUM / DEN; groups are the connected components
of that relation.  Equal sets are one key.  Sets whose fingerprints (SimHash of
the set) differ by at most ``RADIUS`` bits are found through vantage-point trees;
their stars of links are compared exactly.  Most sets that are just similar
enough differ by more bits than any tree can take, so the rest is found by their
shingles, and no link depends on a fingerprint.  Sets that similar share one of
their first n - ceil(n * NUM / DEN) + 1 shingles in any one order of all
shingles (prefix filter), so each document is posted under those only, and no
pair is missed.  The order takes shingles that are common in a sample last;
the sample changes the work, never the result.

Postings meet once, by shingle; those of one document only go no further.
Shingles that the same documents have, as those of a passage, are one crowd,
at the first of their places.  Each crowd has a pivot, the set whose own
postings are shared most: of copies that is the text they were made from.
Sets are compared with their pivots first.  What then shares a crowd but no
component is compared pair by pair, if the places in both sets and parities of
them leave room for enough common shingles; both tests only let pass too much,
never too little.  Sets themselves are moved for what passes.  Shingles that are common in the sample are
dealt to so many salts that each has about ``CROWD`` documents, with a pivot
of its own; pivots of one shingle are compared with the most shared of them.

Texts without words (null, empty, white space) are copies of each other; a
text of fewer than five words is one shingle.  Long texts are taken whole.
Repeated rows are copies; of rows that share the least doc_id of their group
one stays, that of the least set and text.  Rows without an id stay only if no
row of their group has one, one a group.  Columns of any other names are kept
as they are; an empty table gives no rows.  Shingles and sets are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import simhash
from marlstone.llm.components import components
from marlstone.llm.durable import durable, released, tables, unused

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, NUM, DEN = 5, 4, 5
SEED = 42
#: Bits by which fingerprints that the trees link may differ.
RADIUS = 3
#: Documents that the order of shingles is learned from, and common shingles kept.
SAMPLE, COMMON = 4096, 1 << 17
#: Documents of a common shingle that share a pivot.
CROWD = 4096
#: Slots of the filter for compared keys.
SLOTS = 1 << 24
#: Words whose hashes, and keys whose postings, a worker remembers.
WORDS, SEEN = 1 << 16, 1 << 16
#: Longs of parities.
LONGS = 8
PARITIES = [f"p{i}" for i in range(LONGS)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, SEED)
        return got


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all words if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    mixed = ids[:n]
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + ids[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _STEP
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def key_of(own: np.ndarray) -> int:
    """A signed digest of the set; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED)).view(np.int64)) if len(own) else 0


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of 512 classes has an odd number of the shingles.

    Sets differ by at least as many shingles as these bits.
    """
    odd = np.bincount((own & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch(own: np.ndarray) -> bytes:
    """Parities of so many classes, a power of two, that there is one a shingle."""
    n = max(64 * LONGS, 1 << (len(own) - 1).bit_length()) if len(own) else 64 * LONGS
    odd = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many classes two sketches differ; the larger is folded first."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that the set is posted under, in order, and how often each
    is in the sample."""
    n = len(own)
    times = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        times = np.where(common[at] == own, often[at], 0)
    order = np.lexsort((own, times))[: n + (-n * NUM // DEN) + 1 if n else 0]
    return own[order], times[order]


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled texts, and of how many."""
    ratio = min(1.0, SAMPLE / max(n, 1))
    some = docs.select("text").filter(F.pmod(F.xxhash64(F.lit("order"), "doc_id", "text"), F.lit(1 << 30)) < ratio * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["shingle"])

    counted = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    found = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    ids, times = found["shingle"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(ids)
    return ids[order], times[order]


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, fingerprint, parities and sketch of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keys, sizes, fps, sketches, bits = [], [], [], [], np.zeros((batch.num_rows, LONGS), np.int64)
            for row, text in enumerate(batch.column(1)):
                own = shingles(text.as_py())
                keys.append(key_of(own))
                sizes.append(len(own))
                fps.append(simhash.majority(own))
                sketches.append(sketch(own))
                bits[row] = parities(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(bits[:, i].copy()) for i in range(LONGS)), pa.array(sketches, pa.binary())], ["doc_id", "key", "size", "fp", *PARITIES, "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, size long, fp long, " + "".join(f"{p} long, " for p in PARITIES) + "sketch binary")


class _Fresh:
    """Whether a key is new to this task, among the last ``SEEN`` at least."""

    def __init__(self) -> None:
        self.young: set[int] = set()
        self.old: set[int] = set()

    def __call__(self, key: int) -> bool:
        known = key in self.young or key in self.old
        if len(self.young) >= SEEN:
            self.old, self.young = self.young, set()
        self.young.add(key)
        return not known


def postings(docs: DataFrame) -> DataFrame:
    """shingle, salt, key, size, and the shingle's place in the set's order.

    The salt is -1 where a shingle isn't dealt.  A key may be posted again by
    another task.
    """
    n = docs.count()
    common, often = _common(docs, n)
    sampled = max(1, min(n, SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in released(batches):
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(0):
                own = shingles(text.as_py())
                key = key_of(own)
                if not len(own) or not fresh(key):
                    continue
                posted, times = prefix(own, common, often)
                salts = times * n // (sampled * CROWD)
                row = posted.view(np.int64), np.where(salts, key % np.maximum(salts, 1), -1).astype(np.int32), np.full(len(posted), key), np.full(len(posted), len(own), np.int32), np.arange(len(posted), dtype=np.int32)
                for column, values in zip(columns, row):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["shingle", "salt", "key", "size", "place"])

    return docs.select("text").mapInArrow(run, "shingle long, salt int, key long, size int, place int")


def _may_be(a: str, b: str) -> Column:
    """Whether sizes, and places of the first shared shingle, leave room."""
    size, other, place, there = F.col(f"{a}size"), F.col(f"{b}size"), F.col(f"{a}place"), F.col(f"{b}place")
    fits = F.least(size, other) * DEN >= F.greatest(size, other) * NUM
    return fits & (F.least(size - place, other - there) * (NUM + DEN) >= (size + other) * NUM)


def _bits_fit(a: str, b: str, longs: int) -> Column:
    """Whether the parities differ by no more than similar sets may."""
    apart = sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(longs)), F.lit(0))
    return apart * (NUM + DEN) <= (F.col(f"{a}size") + F.col(f"{b}size")) * (DEN - NUM)


def similar(docs: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (keys a, b) whose sets are similar enough."""
    named = lambda c, *more: points.select(*(F.col(x).alias(f"{c}_{x}") for x in ("key", *more)))
    both = lambda pairs, *more: pairs.join(named("a", *more), F.col("a") == F.col("a_key")).join(named("b", *more), F.col("b") == F.col("b_key"))
    some = both(pairs, "size", *PARITIES).filter(_bits_fit("a_", "b_", LONGS)).select("a", "b", (F.col("a_size") + F.col("b_size")).alias("sizes"))

    def near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keep = [bits_apart(x.as_py(), y.as_py()) * (NUM + DEN) <= n * (DEN - NUM) for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = durable(both(some, "sketch").select("a", "b", "sizes", "a_sketch", "b_sketch").mapInArrow(near_enough, "a long, b long"))
    slots = near.select(F.explode(F.array("a", "b")).alias("key")).select((F.pmod("key", F.lit(SLOTS)) + 1).alias("slot"))
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    packed = np.zeros(SLOTS // 8, np.uint8)
    for x in blocks:
        packed[4096 * (x["block"] - 1) : 4096 * x["block"]] = np.frombuffer(x["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        # the slots are a filter only: what they let through by chance finds no pair
        for batch in released(batches):
            keys, sets = [], []
            for text in batch.column(0):
                own = shingles(text.as_py())
                key = key_of(own)
                at = key % SLOTS
                if packed[at >> 3] >> (at & 7) & 1 and fresh(key):
                    keys.append(key)
                    sets.append(own.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "own"])

    sets = durable(docs.select("text").mapInArrow(run, "key long, own binary").dropDuplicates(["key"]))
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append((DEN + NUM) * both >= NUM * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def by_fingerprint(points: DataFrame) -> DataFrame:
    """Pairs of keys (a, b) that connect all sets within ``RADIUS`` bits."""
    some = points.filter("size > 0").select("key", "fp")
    named = durable(some.groupBy("fp").agg(F.min("key").alias("least")))
    of = lambda c: named.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key"))
    stars = simhash.link(named, RADIUS).join(of("a"), "a").join(of("b"), "b").select("a_key", "b_key")
    equal = some.join(named, "fp").filter("key <> least").select("key", "least")
    return stars.union(equal).toDF("a", "b")


def groups(docs: DataFrame, marked: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key`` and ``root`` of all keys that have near copies."""
    points = keep(marked.groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "fp", *PARITIES, "sketch"))))
    near = by_fingerprint(points).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    own = Window.partitionBy("shingle", "salt")
    half = lambda bits: F.sum(F.shiftrightunsigned(F.xxhash64("key"), bits).bitwiseAND(F.lit(0xFFFFFFFF))).over(own)
    met = postings(docs).select("*", F.min("key").over(own).alias("__low"), F.max("key").over(own).alias("__high"), F.count("*").over(own).alias("n"), half(0).alias("__h"), half(32).alias("__g"))
    # another salt may have what this one hasn't
    met = met.filter((F.col("__low") < F.col("__high")) | (F.col("salt") >= 0))
    crowd = F.when(F.col("salt") < 0, F.xxhash64("__h", "__g", "n")).otherwise(F.xxhash64("shingle"))
    shared = met.select(crowd.alias("crowd"), "salt", "key", "size", "place", "n").groupBy("crowd", "salt", "key")
    shared = keep(shared.agg(F.first("size").alias("size"), F.min("place").alias("place"), F.sum("n").alias("n")))
    weight = shared.groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    weight = weight.select("key", (F.col("n") / (F.col("size") - F.ceil(F.col("size") * NUM / DEN) + 1)).cast("float").alias("weight"))
    weighed = shared.drop("n").join(weight, "key")
    candidate = F.struct("weight", "key", "size", "place")
    pivoted = weighed.select("key", "size", "place", F.max(candidate).over(Window.partitionBy("crowd", "salt")).alias("o"))
    pivoted = pivoted.select("key", "size", "place", *(F.col(f"o.{c}").alias(f"o_{c}") for c in ("key", "size", "place")))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = pivoted.filter((F.col("key") != F.col("o_key")) & _may_be("", "o_")).select(*ordered(F.col("key"), F.col("o_key")))
    dealt = weighed.filter("salt >= 0").groupBy("crowd", "salt").agg(F.max(candidate).alias("own"))
    chief = dealt.groupBy("crowd").agg(F.max("own").alias("chief"))
    between = dealt.join(chief, "crowd").filter("own.key <> chief.key").select(*ordered(F.col("own.key"), F.col("chief.key")))
    compared = durable(near.union(first).union(between).distinct())
    links = similar(docs, points, compared)

    root = components(links).withColumnRenamed("node", "key")
    rooted = points.join(root, "key", "left").select("key", F.coalesce("root", "key").alias("root"), *PARITIES)
    placed = shared.select("crowd", "key", "size", "place").join(rooted, "key")
    mixed = placed.groupBy("crowd").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("crowd")
    left = placed.join(mixed, "crowd").select("crowd", "key", "size", "place", "root", *PARITIES)
    other = left.toDF("crowd", *(f"o_{c}" for c in left.columns[1:]))
    rest = left.join(other, "crowd").filter((F.col("key") < F.col("o_key")) & (F.col("root") != F.col("o_root")) & _may_be("", "o_") & _bits_fit("", "o_", LONGS))
    rest = rest.select(F.col("key").alias("a"), F.col("o_key").alias("b")).distinct()
    more = similar(docs, points, durable(rest.join(compared, ["a", "b"], "left_anti")))
    return components(links.union(more)).withColumnRenamed("node", "key")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, and root and component_id, the least doc_id of the group."""
    with tables(docs.sparkSession) as keep:
        return _near_copies(docs, keep(marks(docs)), keep)


def _near_copies(docs: DataFrame, marked: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    points = marked.groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = points.join(groups(docs, marked, keep), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return durable(marked.select("doc_id", "key").join(placed.select("key", "root").join(whole, "root"), "key").select("doc_id", "key", "root", "component_id"))


def _with_keys(docs: DataFrame, name: str) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keys = pa.array([key_of(shingles(t.as_py())) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: of the least doc_id, set and text."""
    found = near_copies(docs)
    key, rank, its_id, its_key = (unused(docs, x) for x in ("__key", "__rank", "__id", "__chosen"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best"))
    chosen = best.select(F.col("best.doc_id").alias(its_id), F.col("best.key").alias(its_key))
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(key) == F.col(its_key))
    rows = _with_keys(docs, key).join(chosen, same, "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("text"))
    return rows.withColumn(rank, place).filter(F.col(rank) == 1).select(*docs.columns)
