"""Token files: the Arrow IPC file format with fixed-size-list batches.

Texts are encoded where they are read; their ids, two bytes each where the
vocabulary allows, are dealt by ranges of doc_id and sorted, and each task
writes its range as one file.  A row of a file is one sequence of ``length`` ids and its
mask, both fixed-size lists, so row i of an uncompressed file lies at a known
place and a memory map gives it without a copy.  Ids are unsigned 16-bit where
the vocabulary allows, else 32-bit.  Beside it lies an index file with doc_id,
start in the file's ids and length of each document, since the end id may also
be an ordinary token.

A file is written under a name of its own attempt, and the table of files,
which Spark commits task by task, names those of the attempts that count: a
task that is run again leaves a file that nothing names, and no file is moved
or changed.  Paths with the scheme
``file`` are written directly (the folder is shared), others through Arrow's
file systems.

Defined results: a null or empty text is its end id alone; a null doc_id comes
first; repeated doc_ids are written one after another, in order of their ids;
an empty table gives no files and no rows; other columns are unread; very long
texts are encoded whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, table, written
from .tokens import encoder

LENGTH = 2048
BATCH_ROWS = 512

_INDEX = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])


def file_system(path: str):
    """The Arrow file system of a folder and the folder's path in it."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)


def _schema(wide: bool, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """One token file and its index."""

    def __init__(self, folder: str, name: str, wide: bool, length: int = LENGTH, batch_rows: int = BATCH_ROWS):
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{name}-{uuid.uuid4().hex}.arrow"
        self.schema, self.kind = _schema(wide, length), np.dtype("<u4" if wide else "<u2")
        self.length, self.rows = length, batch_rows
        self.sink = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.fs.open_output_stream(f"{self.folder}/{self.name}.index")
        self.index = pa.ipc.new_file(self.index_sink, _INDEX)
        self.rest = np.zeros(0, self.kind)
        self.total = 0

    def add(self, docs: pa.Array, ids: list[bytes]) -> None:
        """Append documents whose ids are in the file's own width."""
        counts = np.array([len(x) // self.kind.itemsize for x in ids], np.int64)
        self.index.write_batch(pa.RecordBatch.from_arrays([docs, pa.array(self.total + np.cumsum(counts) - counts), pa.array(counts)], schema=_INDEX))
        self.total += int(counts.sum())
        self.rest = np.concatenate([self.rest, np.frombuffer(b"".join(ids), self.kind)])
        whole = len(self.rest) // self.length // self.rows * self.rows * self.length
        if whole:
            self._write(self.rest[:whole], whole)
            self.rest = self.rest[whole:]

    def _write(self, ids: np.ndarray, real: int) -> None:
        step = self.rows * self.length
        for k in range(0, len(ids), step):
            part = np.ascontiguousarray(ids[k : k + step])
            mask = np.arange(k, k + len(part)) < real
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> int:
        if n := len(self.rest):
            padded = np.zeros(-(-n // self.length) * self.length, self.kind)
            padded[:n] = self.rest
            self._write(padded, n)
        for x in (self.out, self.sink, self.index, self.index_sink):
            x.close()
        return self.total


def read_documents(folder: str, name: str) -> Iterator[tuple[list[int], np.ndarray, list[bytes]]]:
    """(doc_ids, starts in the file, ids as little-endian unsigned 32-bit) by batches of the index."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}") as data, fs.open_input_file(f"{path}/{name}.index") as marks:
        tokens, index = pa.ipc.open_file(data), pa.ipc.open_file(marks)
        held, first, k = np.zeros(0, "<u4"), 0, 0
        for i in range(index.num_record_batches):
            part = index.get_batch(i)
            if not part.num_rows:
                continue
            at, n = (part.column(c).to_numpy() for c in (1, 2))
            end = int(at[-1] + n[-1])
            more = [held]
            have = first + len(held)
            while have < end:
                batch = tokens.get_batch(k)
                ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                more.append(ids[mask].astype("<u4"))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more)
            cut = at - first
            yield part.column(0).to_pylist(), at, [held[a:b].tobytes() for a, b in zip(cut.tolist(), (cut + n).tolist())]
            held, first = held[end - first :], end


def sequence(folder: str, name: str, i: int, batch_rows: int = BATCH_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row i of a local file through a memory map: its ids (no copy) and mask."""
    _, path = file_system(folder)
    batch = pa.ipc.open_file(pa.memory_map(f"{path}/{name}")).get_batch(i // batch_rows)
    return tuple(batch.column(c)[i % batch_rows].values.to_numpy(zero_copy_only=not c) for c in (0, 1))


def write_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = 1, length: int = LENGTH) -> DataFrame:
    """Write token files in ascending doc_id order; (part, n_docs, n_tokens, name) of each file."""

    wide = encoder(tokenizer, end).size > 1 << 16
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are found from doc_id alone, so that texts are encoded once and by no pass that only looks for ranges.
    cut = docs.select(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)] or [1.0], 10_000).alias("cut")).first().cut
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cut or [], np.int64)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end).encode
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = encode(batch.column(1).to_pylist())
                ids = ids if wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                part = np.searchsorted(bounds.value, batch.column(0).fill_null(-(1 << 63)).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        for whole in batches:
            for batch in slices(whole, "ids"):
                out = out or Writer(folder, f"part-{part:08d}", wide, length)
                out.add(batch.column(0), batch.column(1).to_pylist())
                n += batch.num_rows
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n], "n_tokens": [out.close()], "name": [out.name]})

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoded, "part int, doc_id bigint, ids binary")
    ranged = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    return written(ranged.mapInArrow(kernel, "part bigint, n_docs bigint, n_tokens bigint, name string"), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files themselves."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for docs, at, ids in read_documents(folder, name):
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + base), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file: their starts are summed on the driver, a few bytes a file.
    rows, base = [], 0
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append((r.name, base))
        base += r.n_tokens
    spark = files.sparkSession
    listed = spark.createDataFrame(rows, "name string, base bigint").repartition(max(1, len(rows)))
    return listed.mapInArrow(kernel, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to Arrow files and read back."""
    folder = fresh_path(spark, "tokens")
    return read_files(write_files(table(spark, sf_dir, "documents", "doc_id", "text"), folder), folder)
