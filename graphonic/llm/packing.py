"""Packing: bounded-space online best fit.

Each task keeps at most ``open_windows`` windows.  A document is cut into full
windows while it is longer than one; the rest goes to the open window that it
fits most tightly.  Where none fits, the fullest window is topped up from the
document's head (unless the gap is under ``least_piece`` ids, which stays
padding) and emitted, and the remainder is placed anew.  What is open at the
end of the tasks is merged in rounds: windows are gathered, at most
``merge_rows`` to a task, and packed again whole, by the same rule.

Only (document, start, length, crc32) travel; texts are read once, in place,
without a shuffle.  Sequence numbers carry the round and the task, so they are
unique without a counter.

Defined results: a null or empty text is its end id alone; repeated rows are
separate documents; an empty table gives no pieces; other columns are unread.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import encoder

LENGTH, OPEN, LEAST_PIECE, MERGE_ROWS = 2048, 16, 16, 16_000
#: Pieces that a worker remembers in each generation: less than the default, for workers that other stages share.
REMEMBERED = 400_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean"
_ARROW = pa.schema([*((x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("open", pa.bool_())])


class Windows:
    """The open windows of one task, ordered by fill."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.order: list[tuple[int, int]] = []  # (ids in it, number of the window)
        self.held: dict[int, list] = {}
        self.made = 0

    def best(self, n: int) -> int | None:
        """Index in order of the fullest window that still takes n ids."""
        k = bisect_left(self.order, (self.length - n + 1, -1)) - 1
        return k if k >= 0 else None

    def add(self, k: int | None, n: int, piece: object) -> tuple[int, list] | None:
        """Put a piece into window k of the order (None: a new one); the window, if that filled it."""
        if k is None:
            fill, w = 0, self.made
            self.made += 1
            self.held[w] = []
        else:
            fill, w = self.order.pop(k)
        self.held[w].append((piece, fill))
        if fill + n == self.length:
            return w, self.held.pop(w)
        insort(self.order, (fill + n, w))
        return None

    def fullest(self) -> tuple[int, list]:
        """Take the fullest window out."""
        _, w = self.order.pop()
        return w, self.held.pop(w)


def _task() -> int:
    return TaskContext.get().partitionId()


def _first_round(name: str, end: int, length: int, most: int, least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, base = encoder(name, end, REMEMBERED).encode, Windows(length, most), _task() << 32
        rows: list[tuple] = []

        def emit(window: tuple[int, list] | None, is_open: bool = False) -> None:
            if window:
                rows.extend((*piece, base + window[0], at, is_open) for piece, at in window[1])

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    total, at = len(ids) // 4, 0
                    while at < total:
                        n = min(total - at, length)
                        k = windows.best(n) if n < length else None
                        if k is None and n < length and len(windows.order) >= most:
                            gap = length - windows.order[-1][0]
                            if gap < least or n - gap < least:
                                emit(windows.fullest())
                                continue
                            n, k = gap, len(windows.order) - 1
                        emit(windows.add(k, n, (doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total)))
                        at += n
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows.clear()
        for _, w in list(windows.order):
            emit((w, windows.held[w]), True)
        if rows:
            yield _batch(rows)

    return kernel


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _merge_round(length: int, most: int, number: int, last: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, base = Windows(length, most), number << 56 | _task() << 32
        rows: list[tuple] = []

        def emit(window: tuple[int, list] | None, is_open: bool = False) -> None:
            if window:
                for pieces, at in window[1]:
                    for p in sorted(pieces, key=lambda p: p["offset"]):
                        rows.append((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], base + window[0], at + p["offset"], is_open))

        found: list[tuple[int, list]] = []
        for batch in batches:
            found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        found.sort(key=lambda x: -x[0])  # at most merge_rows of them: the largest first
        for n, pieces in found:
            k = windows.best(n)
            if k is None and len(windows.order) >= most:
                emit(windows.fullest())
            emit(windows.add(k, n, pieces))
        for _, w in list(windows.order):
            emit((w, windows.held[w]), not last)
        if rows:
            yield _batch(rows)

    return kernel


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 1, length: int = LENGTH, open_windows: int = OPEN, least_piece: int = LEAST_PIECE, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """One row for each piece of each document: where it starts, how long it is, in which sequence it lies and where."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    now = written(docs.mapInArrow(_first_round(tokenizer, end, length, open_windows, least_piece), SCHEMA), "pieces")
    done = now.where("not open")
    number, last = 0, False
    while not last:
        number += 1
        left = now.where("open").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.collect_list(F.struct("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")).alias("pieces"))
        left = written(left.select("n", "pieces"), "open-windows")
        tasks = -(-left.count() // merge_rows)
        last = tasks <= 1 or number >= 8
        # Windows are merged largest first with as many open as a task holds, so that little padding stays.
        now = written(left.coalesce(max(tasks, 1)).mapInArrow(_merge_round(length, merge_rows if last else open_windows, number, last), SCHEMA), "merged")
        done = done.unionByName(now.where("not open"))
    return done.drop("open")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
