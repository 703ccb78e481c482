"""SimHash near-duplicates through vantage-point trees.

Equal fingerprints are one point.  A node of a tree holds a vantage point and
a bound m: points within m go to the near branch, points beyond m - radius to
the far branch.  By the triangle inequality two points within ``radius`` of
each other share a branch, so they share a leaf, whatever the vantage points:
only points in the shell between both bounds are stored twice.  A tree built
from a bounded sample deals all points to shards; every shard goes on with a
tree of its own points down to small leaves, in which all distances are taken.
Leaves emit the edges of a star for each of their components, which keeps
every connection and no pair twice.

The shell isn't small: of evenly spread 64-bit points a radius of 2 leaves
about a fifth there, so each halving moves 1.2 times the points.  Trees within
a shard cost no traffic, so shards are as large as a worker holds with ease
(``SHARD`` points, 2 MB of fingerprints), and only the halvings that part the
shards are paid in rows: 1.4 a point at a million points, about 7 at a billion.

Texts without words (null, empty, white space) have fingerprint zero and are
linked like any other; long texts are taken whole.  Repeated rows and ties
link as equal fingerprints; a doc_id may be null or repeated.  A component
without a non-null doc_id has a null component_id.  Other columns of the input
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.durable import durable, released

LEAF = 256
#: Points of a shard, and sampled points of each that the dealing tree has.
SHARD, SAMPLE = 1 << 18, 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits; each is set if it is in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The best of a few vantage points and its bound; None if none divides."""
    best, most = None, int(0.9 * len(points))
    for k in range(8):
        vantage = points[(2 * k + 1) * len(points) // 16]
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        far = len(points) - np.concatenate([np.zeros(radius, np.int64), within[:-radius]]) if radius else len(points) - within
        larger = np.maximum(within, far)
        m = int(larger.argmin())
        if larger[m] < most:
            best, most = (vantage, m), int(larger[m])
    return best


def grow(points: np.ndarray, radius: int, leaf: float) -> list:
    """Nodes (vantage, m, near, far); a child below zero is leaf ~child."""
    nodes: list = []
    leaves = 0

    def build(own: np.ndarray) -> int:
        nonlocal leaves
        cut = _split(own, radius) if len(own) > leaf else None
        if cut is None:
            leaves += 1
            return -leaves
        vantage, m = cut
        far = np.bitwise_count(own ^ vantage).astype(int)
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (vantage, m, build(own[far <= m]), build(own[far > m - radius]))
        return at

    build(points)
    return nodes


def deal(nodes: list, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf's number and the points that belong there."""
    todo = [(0 if nodes else -1, points)]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            yield -at - 1, own
            continue
        vantage, m, near, far = nodes[at]
        distance = np.bitwise_count(own ^ vantage).astype(int)
        todo += [(near, own[distance <= m]), (far, own[distance > m - radius])]


def _leaf_links(points: np.ndarray, radius: int) -> tuple[list, list]:
    """Pairs within the radius among one leaf's points, in blocks."""
    left, right = [], []
    for at in range(0, len(points), LEAF):
        block = points[at : at + LEAF]
        for other in range(at, len(points), 4096):
            rest = points[other : other + 4096]
            i, j = np.nonzero(np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius)
            keep = i + at < j + other
            left.append(block[i[keep]])
            right.append(rest[j[keep]])
    return left, right


def star_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked point to its component's least point here."""
    order = np.sort(points)
    parent = np.arange(len(order))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    todo = [order]
    while todo:
        own = todo.pop()
        cut = _split(own, radius) if len(own) > LEAF else None
        if cut is not None:
            distance = np.bitwise_count(own ^ cut[0]).astype(int)
            todo += [own[distance <= cut[1]], own[distance > cut[1] - radius]]
            continue
        for a, b in zip(*_leaf_links(own, radius)):
            for x, y in zip(np.searchsorted(order, a).tolist(), np.searchsorted(order, b).tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(order))], np.int64)
    linked = roots != np.arange(len(order))
    return order[linked], order[roots[linked]]


def link(points: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all points (column fp) within ``radius``."""
    n = points.count()
    # a shard for each core as well, if there are points enough
    cores = points.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(cores, n // 4096))
    # a sample fits the dealing tree; all points then go through it
    ratio = min(1.0, SAMPLE * shards / max(n, 1))
    some = points.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < ratio * (1 << 40))
    nodes = grow(np.unique(some.toArrow().column("fp").to_numpy().view(np.uint64)), radius, 1.5 * SAMPLE)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, got in deal(nodes, own, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), leaf, np.int32)), pa.array(got.view(np.int64))], ["shard", "fp"])

    def search(group: pa.Table) -> pa.Table:
        a, b = star_links(group.column("fp").to_numpy().astype(np.int64).view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.select("fp").mapInArrow(route, "shard int, fp long").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id, and the links of the component.

    One row per row of ``docs``; n_documents is the component's size.
    """
    marked = durable(fingerprints(docs, width, seed))
    points = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    labels = components(link(points, radius))
    placed = points.join(labels, points.fp == labels.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_documents"))
    of_point = placed.select("fp", "root").join(whole, "root").select("fp", "component_id", "n_documents")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_point, "fp").select("doc_id", hexed, "component_id", "n_documents")
