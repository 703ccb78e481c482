"""Byte-level BPE over a table of the corpus' distinct words, and back.

Words are split once and numbered within blocks of documents, so a document is
a list of places in its block's words.  The blocks'
words are dealt by a hash into buckets; in a bucket each distinct word of the
corpus is encoded once, and its ids go back to every block that has it, where
they are put in the words' places.  Decoding looks each id up in the vocabulary
(a table of its size) and puts the pieces together.

What is held at once has a bound: a block ends with the document that brings it
to ``BLOCK_WORDS`` distinct words or ``BLOCK_CHARS`` characters, a bucket is a
share of the corpus' distinct words that doesn't grow with their repetitions.
Hot words cost one entry a block.

The split runs twice, for words and for documents, and costs less than keeping
what it gives.  Both runs, and those again after an executor was lost, must see
rows in one order, as scans of tables do; documents that come out of a shuffle
are checkpointed first.  The mark of a block's words is compared, so that
another order would be an error, never a wrong result.

Null texts count as empty (no ids, empty decoded text).  Empty tables give no
rows.  Other columns of the input, whatever their names, are ignored; repeated
rows and null ids give results of their own.  Long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.durable import durable, released
from marlstone.llm.token_table import pieces, spaced_words, tokenizer_of

BLOCK_WORDS, BLOCK_CHARS = 1 << 18, 1 << 25
#: Buckets: one for so many bytes of text, within these limits.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 22, 64, 65536
#: Bytes of pieces that are broadcast.
MOST_PIECES = 1 << 26
_SPLIT = ["block", "mark", "bucket", "places", "words", "docs", "sizes"]


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by significance, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_pieces(parts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, parts), "<u4", len(parts))
    return zlib.compress(len(parts).to_bytes(4, "little") + sizes.tobytes() + b"".join(parts), 1)


def _unpack_pieces(packed: bytes) -> list[bytes]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    at, out = 4 + 4 * n, []
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def split(docs: DataFrame, key: str, text: str, buckets: int, words: bool) -> DataFrame:
    """Blocks of documents: their words, or the documents as places of words.

    Word rows have ``words`` of one bucket and their ``places``; a block's
    document row has no bucket but ``docs`` (keys), ``sizes`` (words of each) and
    the ``places`` of all.  Both carry the ``mark`` of the block's words.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, place = None, 0, {}
        keys, sizes, places = [], [], []
        key_type = pa.null()

        def close() -> pa.RecordBatch:
            coded = [w.encode() for w in place]
            mark = xxhash.xxh3_64_intdigest(b"\0".join(coded)) >> 1
            rows: list[list] = [[] for _ in _SPLIT]
            if words:
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in coded), np.int32, len(coded))
                order = np.argsort(bucket, kind="stable")
                bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = order[a:b]
                    row = block, mark, int(bucket[own[0]]), _pack(own), _pack_pieces([coded[i] for i in own.tolist()]), None, None
                    for column, value in zip(rows, row):
                        column.append(value)
            else:
                for column, value in zip(rows, (block, mark, None, _pack(np.concatenate(places)), None, keys, _pack(np.array(sizes)))):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(key_type), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], _SPLIT)

        for batch in released(batches):
            key_type = batch.schema.field(0).type
            if block is None and batch.num_rows:
                block = batch.column(2)[0].as_py() << 32
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = spaced_words(body or "")
                # in an order that doesn't depend on the process
                for w in sorted(set(found).difference(place)):
                    place[w] = len(place)
                keys.append(doc)
                if not words:
                    sizes.append(len(found))
                    places.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
                chars += len(body or "")
                if len(place) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                    yield close()
                    block, chars, place = block + 1, 0, {}
                    keys, sizes, places = [], [], []
        if keys:
            yield close()

    # the partition's number among its own, not among those of a union
    part = F.spark_partition_id().cast("long")
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), part.alias("p")).mapInArrow(run, f"block long, mark long, bucket int, places binary, words binary, docs array<{kind}>, sizes binary")


def _encoded_words(found: DataFrame, path: str) -> DataFrame:
    """Word rows with ids for words; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        now, known = None, {}
        for batch in released(batches):
            out = []
            for bucket, packed in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                own = _unpack_pieces(packed)
                fresh = [w for w in own if w not in known]
                for word, got in zip(fresh, tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)):
                    known[word] = np.array(got.ids, "<u4").tobytes()
                out.append(_pack_pieces([known[w] for w in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], ["block", "mark", "places", "ids"])

    return found.sortWithinPartitions("bucket").select("block", "mark", "bucket", "places", "words").mapInArrow(run, "block long, mark long, places binary, ids binary")


def _each(docs: DataFrame, path: str, key: str, text: str, result: str, of: Callable[[], Callable[[bytes], tuple]], kinds: list[pa.DataType]) -> DataFrame:
    """``key`` and what ``of()`` makes of the ids of each text."""
    spark, docs = docs.sparkSession, in_one_order(docs)
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_CHARS)
    coded = _encoded_words(split(docs, key, text, buckets, True).repartition(min(n, buckets), "bucket"), path)
    lists = split(docs, key, text, buckets, False).select("block", "mark", F.lit(1).alias("step"), "places", F.lit(None).cast("binary").alias("ids"), "docs", "sizes")
    table = coded.select("block", "mark", F.lit(0).alias("step"), "places", "ids", F.lit(None).cast(f"array<{kind}>").alias("docs"), F.lit(None).cast("binary").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of()
        now, words_mark, ids_at = None, None, {}
        for batch in released(batches):
            for block, mark, step, places, ids, keys, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, words_mark, ids_at = block, mark, {}
                if mark != words_mark:
                    raise RuntimeError("the documents came in another order when read again: checkpoint them first")
                if step == 0:
                    ids_at.update(zip(_unpack(places).tolist(), _unpack_pieces(ids)))
                    continue
                at, made, where = 0, [], _unpack(places).tolist()
                for n_words in _unpack(sizes).tolist():
                    made.append(make(b"".join(map(ids_at.__getitem__, where[at : at + n_words]))))
                    at += n_words
                columns = [pa.array(keys, batch.schema.field(5).type.value_type), *(pa.array(c, t) for c, t in zip(zip(*made), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["k", *(f"c{i}" for i in range(len(kinds)))])

    together = table.unionByName(lists).repartition(n, "block").sortWithinPartitions("block", "step")
    columns = result.split(", ")
    shape = ", ".join(f"c{i} {x.split(' ', 1)[1]}" for i, x in enumerate(columns))
    return together.mapInArrow(run, f"k {kind}, {shape}").toDF(key, *(x.split(" ", 1)[0] for x in columns))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each whole text."""
    return _each(docs, path, key, text, "ids array<int>", lambda: lambda ids: (np.frombuffer(ids, "<i4"),), [pa.list_(pa.int32())])


def in_one_order(docs: DataFrame) -> DataFrame:
    """``docs``, kept first if its rows may come in another order when read
    again, as those of a shuffle may."""
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    shuffled = ("Aggregate", "Join", "Window", "Exchange", "Repartition", "Sort", "Limit", "Rand", "Groups")
    return durable(docs) if any(x in plan for x in shuffled) else docs


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of each list of ids; null lists decode to ''.

    Ids are joined with the table of their pieces, which is as long as the
    vocabulary and broadcast if that is below ``MOST_PIECES`` bytes.
    """
    spark, table = encoded.sparkSession, pieces(path)
    found = spark.createDataFrame(list(enumerate(table)), "id int, piece binary")
    numbered = encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("row"))
    each = numbered.select("k", "row", F.posexplode_outer("ids").alias("pos", "id"))
    joined = each.join(F.broadcast(found) if sum(map(len, table)) <= MOST_PIECES else found, "id", "left")
    whole = joined.groupBy("row").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")).cast("string"))
    return whole.select(F.col("k").alias(key), text.alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and SHA-256 of its ids and of their decoding.

    In one pass, so that the ids never leave the worker: each is joined with
    its piece by the same table, which every worker holds.
    """

    def of() -> Callable[[bytes], tuple]:
        piece = pieces(path)

        def make(ids: bytes) -> tuple:
            back = b"".join(map(piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()

        return make

    return _each(docs, path, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", of, [pa.int64(), pa.string(), pa.string()])
