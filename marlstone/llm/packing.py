"""Bounded-space online packing of token sequences.

Every partition keeps ``open_windows`` windows.  A document (its ids and the
end id) is cut only where it is longer than a window; what remains goes into
the open window that it fills best, and when it fits none, the fullest window
is emitted and a new one opened.  The windows left open in the partitions meet
``FAN_IN`` partitions at a time, where their pieces are placed best-fit, the
longest first.  A partition leaves at most ``open_windows`` windows, so that
last step has bounded groups, whatever the corpus.

Null and empty texts are the end id alone; long texts are cut into as many
windows as they need.  An empty table has no pieces.  Repeated rows are packed
each, doc_ids may be null.  Of windows with equal room the one opened first is
taken; equal pieces are placed in the order of partition, doc_id and start.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.durable import durable, released
from marlstone.llm.token_table import bare_words, done, table

FAN_IN = 16
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows by room left; ``place`` returns what it had to emit."""

    def __init__(self, size: int, most: int | None) -> None:
        self.size, self.most, self.made = size, most, 0
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, length: int, piece: tuple) -> tuple[int, list] | None:
        emitted = None
        at = bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if self.most is not None and len(self.rooms) >= self.most:
                _, fullest = self.rooms.pop(0)
                emitted = fullest, self.held.pop(fullest)
            room, window = self.size, self.made
            self.made += 1
            self.held[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.held[window].append((*piece, self.size - room))
        if room == length:
            full = window, self.held.pop(window)
            return full if emitted is None else (None, [emitted, full])
        insort(self.rooms, (room - length, window))
        return emitted


def _emitted(got) -> list:
    return [] if got is None else got[1] if got[0] is None else [got]


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, open_windows: int = 64) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = table(path, bare_words), Windows(window, open_windows)
        part = TaskContext.get().partitionId()
        key = pa.null()
        rows: list[tuple] = []

        def close(sequence: int | None, pieces: list) -> None:
            rows.extend((doc, start, n, crc, total, sequence, offset, part) for doc, start, n, crc, total, offset in pieces)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in released(batches):
            key = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    cut = ids[4 * start : 4 * (start + window)]
                    n = len(cut) // 4
                    for sequence, pieces in _emitted(held.place(n, (doc, start, n, zlib.crc32(cut), total))):
                        close((part << 32 | sequence) * 2, pieces)
            if rows:
                yield batch_of()
        for pieces in held.held.values():
            close(None, pieces)
        if rows:
            yield batch_of()
        done()

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        held, bucket = Windows(window, None), group.column("part")[0].as_py() // FAN_IN
        sequence, offset = [0] * len(group), [0] * len(group)

        def close(got: int, pieces: list) -> None:
            for row, at in pieces:
                sequence[row], offset[row] = (bucket << 32 | got) * 2 + 1, at

        for row, n in enumerate(group.column("length").to_pylist()):
            for got in _emitted(held.place(n, (row,))):
                close(*got)
        for got in held.held.items():
            close(*got)
        kept = group.select(names[:5])
        return kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    placed = durable(docs.select("doc_id", "text").mapInArrow(first, f"doc_id {kind}, {PIECE}, part long"))
    left = placed.filter(F.col("sequence_id").isNull())
    merged = left.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, f"doc_id {kind}, {PIECE}")
    return placed.filter(F.col("sequence_id").isNotNull()).select(names[:-1]).unionByName(merged)
