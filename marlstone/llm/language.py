"""Language by nearest centroid over hashed byte n-grams.

Texts are lower-cased, everything between letters becomes one space, and the
bytes' 1- to 4-grams are counted in ``DIMENSIONS`` slots, weighted by the
logarithm of their count and their inverse document frequency, and normalised.
Each language has up to ``clusters`` centroids, found by spherical k-means, so
that kinds of text (shouting, tables, letters) needn't share one.  A text gets
the language of the nearest centroid by cosine.  It is rejected if that is
lower than of all but QUANTILE of the learned texts of about its length, each
scored by a model that was learned without it.

The model learns from at most ``per_language`` labelled texts a language and
``most_texts`` in all, of the ``LANGUAGES`` most frequent languages, chosen by
a hash of doc_id; these bounds are also those of the driver's memory.
Predictions use whole texts, however long, and nothing else.  Null texts and
texts without a letter are ``und``, rejected, with score 0; so is everything
if nothing is labelled.  Ties go to the language first in order.  Null
doc_ids and repeated rows are predicted each; an empty table gives no rows.
Further columns, whatever their names, stay in ``keep_known`` and are ignored
by ``predict``.  Where no language was learned, ``keep_known`` keeps what can
be read at all: texts with a letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.durable import released

DIMENSIONS, BLOCK = 8192, 64
#: Share of known texts below the floor, and folds and lengths it is measured in.
QUANTILE, FOLDS, LENGTHS = 0.005, 3, 12
#: Share of a language's texts that makes a kind of text; fewer are taken for wrong labels.
SUPPORT = 0.05
#: Languages that are learned at most.
LANGUAGES = 512
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def counts(text: str | None) -> np.ndarray:
    """How often each slot's n-grams occur."""
    raw = _LETTERS[np.frombuffer(f" {text or ''} ".lower().encode(), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep].astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    gram = b
    for n, factor in enumerate(_FACTORS):
        if n:
            gram = gram[:-1] << np.uint32(8) | b[n:]
        total += np.bincount((gram * factor) >> np.uint32(19), minlength=DIMENSIONS)
    return total


class Centroids:
    """``names`` and ``points`` (a row each), ``idf`` and the floor's curve."""

    def __init__(self, names: list[str], points: np.ndarray, idf: np.ndarray) -> None:
        self.names, self.points, self.idf = names, points, idf
        #: logarithms of n-gram counts, the usual cosine there, and the least share of it
        self.lengths, self.usual, self.share = np.zeros(1), np.ones(1), 0.0

    def expected(self, sizes: np.ndarray) -> np.ndarray:
        """The usual cosine of known texts with so many n-grams.

        Under the shortest length it falls with the root of the count, as it
        does for a few n-grams against a dense centroid.
        """
        at = np.log(np.maximum(sizes, 1))
        return np.interp(at, self.lengths, self.usual) * np.exp(np.minimum(0.0, (at - self.lengths[0]) / 2))

    def vectors(self, table: np.ndarray) -> np.ndarray:
        weighted = np.log1p(table, dtype=np.float32) * self.idf
        return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)

    def nearest(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        readable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(readable) if self.names else 0, BLOCK):
            own = readable[at : at + BLOCK]
            table = np.stack([counts(texts[i]) for i in own])
            likeness = self.vectors(table) @ self.points.T
            for i, row, floor in zip(own, likeness, self.share * self.expected(table.sum(1))):
                best = int(row.argmax())
                score = min(1.0, max(0.0, float(row[best])))
                out[i] = self.names[best], score, score < floor
        return out


def _cluster(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means and each vector's; starts far apart."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    points = vectors[chosen]
    own = np.zeros(len(vectors), int)
    for _ in range(20):
        own = (vectors @ points.T).argmax(1)
        for c in range(len(points)):
            if (own == c).any():
                mean = vectors[own == c].mean(0)
                points[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return points, own


def _learned(names_of: list[str], table: np.ndarray, clusters: int) -> Centroids:
    idf = (np.log((1 + len(table)) / (1 + (table > 0).sum(0))) + 1).astype(np.float32)
    model = Centroids([], np.zeros((0, DIMENSIONS), np.float32), idf)
    names, points = [], []
    for lang in sorted(set(names_of)):
        members = model.vectors(table[[name == lang for name in names_of]])
        centres, own = _cluster(members, clusters)
        for c in range(len(centres)):
            if (own == c).any() and (own == c).mean() >= SUPPORT:
                names.append(lang)
                points.append(centres[c])
    if names:
        model.names, model.points = names, np.stack(points)
    return model


def train(rows: list[tuple[str, np.ndarray]], clusters: int) -> Centroids:
    names_of = [name for name, _ in rows]
    table = np.stack([x for _, x in rows]) if rows else np.zeros((0, DIMENSIONS))
    model = _learned(names_of, table, clusters)
    if len(rows) < FOLDS:
        return model
    scores, fold = np.zeros(len(rows)), np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        part = _learned([n for n, f in zip(names_of, fold) if f != k], table[fold != k], clusters)
        own = np.flatnonzero(fold == k)
        for at in range(0, len(own), 512):
            scores[own[at : at + 512]] = (part.vectors(table[own[at : at + 512]]) @ part.points.T).max(1)
    lengths = np.log(np.maximum(table.sum(1, dtype=np.int64), 1))
    bins = np.array_split(np.argsort(lengths, kind="stable"), min(LENGTHS, len(rows)))
    model.lengths = np.array([np.median(lengths[i]) for i in bins])
    model.usual = np.maximum.accumulate([np.median(scores[i]) for i in bins])
    model.share = float(np.quantile(scores / np.maximum(model.expected(np.exp(lengths)), 1e-12), QUANTILE))
    return model


def held_out(key: Column) -> Column:
    """The quarter of documents that nothing is learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, clusters: int = 4, per_language: int = 500, most_texts: int = 8192) -> Centroids:
    """Model of at most ``per_language`` texts of each learned language."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    seen = {x["lang"]: x["n"] for x in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not seen:
        return train([], clusters)
    per_language = min(per_language, max(1, most_texts // len(seen)))
    # twice the expected number, by hash, before anything is ranked
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(seen.items()) for x in (lang, min(1.0, 2 * per_language / n))))
    ratio = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    order = F.xxhash64(F.lit("language"), "doc_id", "text")
    some = labelled.withColumn("order", order).filter(F.pmod("order", F.lit(1 << 20)) < ratio * (1 << 20))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            packed = [zlib.compress(np.minimum(counts(t), 65535).astype("<u2").tobytes(), 1) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["lang", "order", "counts"])

    ranked = some.select("lang", "order", "text").mapInArrow(features, "lang string, order long, counts binary")
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "counts"))).filter(F.col("rank") <= per_language)
    rows = sorted((x["lang"], x["order"], bytes(x["counts"])) for x in first.collect())
    return train([(lang, np.frombuffer(zlib.decompress(c), "<u2")) for lang, _, c in rows], clusters)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = model.nearest(batch.column(1).to_pylist())
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` without the rows that the model rejects, columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = batch.column(at).to_pylist()
            kept = [not x[2] for x in model.nearest(texts)] if model.names else [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
