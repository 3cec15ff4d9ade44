"""Benchmark decontamination by winnowing.

A document's words are hashed, then its k-grams; in each run of ``w`` k-grams
the smallest hash is kept as a fingerprint.  A shared run of ``k + w - 1``
words (``window`` below) has the same k-grams in both texts, hence the same
smallest one, so no shared run of that length is missed.  Fingerprints are
joined with those of the benchmark, and each hit is extended: the windows
around it are compared word by word, so nothing is reported by hash alone.

Two ways to join, by the benchmark's measured size:

* at most ``index_bytes`` of index (sorted arrays of hashes and places, about
  ten times the text): it is broadcast once and documents are scanned in place,
  without a shuffle;
* beyond: fingerprints, then candidate windows, are joined by shuffles
  (``left_semi`` on distinct keys, which adaptive execution can split).

Defined results: a null or empty text has no words and no hits; a null
benchmark text has no windows; repeated items each count; items of fewer
words than a window are one window; extra columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, ROW, byte_prefix, mixed, numbered, ragged, slices, span_hash, spans, table, text_bytes, written

WINDOW, KGRAM = 10, 5
#: Bytes of the benchmark's index up to which it is broadcast, and of its text up to which the index is made at all.
INDEX_BYTES = 96_000_000
TEXT_BYTES = INDEX_BYTES // 8

HITS = "array<struct<start: int, end: int>>"
SCHEMA = f"doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans {HITS}"


class Words:
    """The words of some texts, hashed."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        lower = LOWER[raw]
        self.start, self.end, self.first = spans(ALNUM[lower], offsets)
        self.lower = lower.tobytes()
        self.hash = span_hash(byte_prefix(lower), self.start, self.end)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each word on, and whether they lie in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + m]
        return mixed(out), self.doc[:m] == self.doc[n - 1 :]

    def grams_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words from each of some words on."""
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k]
        return mixed(out)

    def winnowed(self, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the smallest k-gram of each run of w that lies in one text."""
        grams, _ = self.grams(k)
        m = len(grams) - w + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.doc[:m] == self.doc[k + w - 2 :]
        least = np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1)
        at = np.unique((np.arange(m) + least)[inside])
        return at, grams[at]

    def run(self, i: int, n: int) -> bytes:
        """The n words from word i on, joined by spaces."""
        return b" ".join([self.lower[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist())])


class Index:
    """Windows of benchmark items as sorted hashes with their places, and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, k: int = KGRAM):
        self.window, self.k = window, k
        self.names = [item for item, _ in items]
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.prints = np.unique(words.winnowed(k, window - k + 1)[1])
        count = np.diff(words.first)
        #: By number of words: hashes in order, and the place and item of each.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(count, window)).tolist():
            if n:
                items_of = np.flatnonzero(count >= n if n == window else count == n)
                each = count[items_of] - n + 1
                place = ragged(words.first[items_of], each)
                h = words.grams_at(place, n)
                order = np.argsort(h, kind="stable")
                self.tables[n] = h[order], place[order].astype(np.int32), np.repeat(items_of, each)[order].astype(np.int32)
        self.lower, self.start, self.end = words.lower, words.start.astype(np.int32), words.end.astype(np.int32)

    @property
    def nbytes(self) -> int:
        arrays = [self.prints, self.start, self.end, *(x for t in self.tables.values() for x in t)]
        return len(self.lower) + sum(x.nbytes for x in arrays) + sum(50 + len(x) for x in self.names)

    def run(self, i: int, n: int) -> bytes:
        return b" ".join([self.lower[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist())])

    def met(self, words: Words, at: np.ndarray, n: int) -> Iterator[tuple[int, int, set[str]]]:
        """Those of the places at which n words are a window, compared word by word, with its items."""
        known, place, item = self.tables[n]
        h = words.grams_at(at, n)
        low, high = np.searchsorted(known, h, side="left"), np.searchsorted(known, h, side="right")
        for k in np.flatnonzero(low < high).tolist():
            run, a, b = words.run(int(at[k]), n), int(low[k]), int(high[k])
            # Equal hashes are equal words but for a collision: every different text behind the hash is looked at.
            found = {self.names[j] for j, i in zip(item[a:b].tolist(), place[a:b].tolist()) if self.run(i, n) == run}
            if found:
                yield int(at[k]), n, found

    def windows(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of every place where a window occurs."""
        if self.window in self.tables:
            at, h = words.winnowed(self.k, self.window - self.k + 1)
            at = at[among(h, self.prints)]
            if len(at):
                reach = self.window - self.k + 1
                lo = np.maximum(at - reach + 1, words.first[words.doc[at]])
                hi = np.minimum(at, words.first[words.doc[at] + 1] - self.window)
                yield from self.met(words, np.unique(ragged(lo, np.maximum(hi - lo + 1, 0))), self.window)
        for n in self.tables:
            if n < self.window:
                grams, inside = words.grams(n)
                at = np.flatnonzero(inside)
                yield from self.met(words, at[among(grams[at], self.tables[n][0])], n)


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted known."""
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _row(doc: object, n: int, found: list[tuple[int, int]], items: set[str]) -> dict:
    hits: list[list[int]] = []
    for a, m in sorted(found):
        if hits and a <= hits[-1][1]:
            hits[-1][1] = max(hits[-1][1], a + m)
        else:
            hits.append([a, a + m])
    hit = sum(b - a for a, b in hits)
    return {"doc_id": doc, "n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": digest(items), "contaminated": hit > 0, "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in hits]}


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _scan(shared):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                for i, n, known in index.windows(words):
                    d = int(words.doc[i])
                    found[d].append((i - int(words.first[d]), n))
                    items[d] |= known
                counts = np.diff(words.first).tolist()
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pylist([_row(ids[d], counts[d], found.get(d, []), items.get(d, set())) for d in range(len(ids))], schema=_ARROW)

    return kernel


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")


def _index(bench: DataFrame, window: int, k: int, index_bytes: int, text_bytes: int):
    """The broadcast index of a benchmark; None where its text, measured first, or the index itself is beyond its bound."""
    size = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size > text_bytes:
        return None
    index = Index([(r.item_id, r.text) for r in bench.collect()], window, k)
    return bench.sparkSession.sparkContext.broadcast(index) if index.nbytes <= index_bytes else None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM, index_bytes: int = INDEX_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Per document: its words, words inside benchmark windows, the items met and the spans hit.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bench = _usable(benchmark)
    shared = _index(bench, window, k, index_bytes, text_bytes)
    if shared is not None:
        return docs.mapInArrow(_scan(shared), SCHEMA)
    return _shuffled(docs, bench, window, k)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM, index_bytes: int = INDEX_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs.

    Within the broadcast bound rows are dropped where they are read; beyond it
    the contaminated rows are joined away by a written row number, so rows
    without a doc_id, or that share one, are judged one by one either way.
    """
    bench = _usable(benchmark)
    shared = _index(bench, window, k, index_bytes, text_bytes)
    if shared is None:
        rows = numbered(docs, "rows")
        found = _shuffled(rows.select(F.col(ROW).alias("doc_id"), F.col("text").cast("string").alias("text")), bench, window, k).where("contaminated").select(F.col("doc_id").alias(ROW)).distinct()
        return rows.join(found, ROW, "left_anti").select(docs.columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(batch.schema.get_field_index("text")))
                keep = np.ones(batch.num_rows, bool)
                for i, _, _ in index.windows(words):
                    keep[words.doc[i]] = False
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(kernel, docs.schema)


def _shuffled(docs: DataFrame, bench: DataFrame, window: int, k: int) -> DataFrame:
    """The same result by shuffle joins, for a benchmark beyond the broadcast bound."""
    w = window - k + 1
    signed = lambda h: h.view(np.int64)

    def prints(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                ids = batch.column(0)
                parts = [(window, *words.winnowed(k, w))]
                for n in lengths:
                    grams, inside = words.grams(n)
                    at = np.flatnonzero(inside)
                    parts.append((n, at, grams[at]))
                for n, at, h in parts:
                    if len(at):
                        d = words.doc[at]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array((at - words.first[d]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(signed(h))], names=["id", "at", "n", "print"])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                ids, rows = batch.column(0).to_pylist(), []
                for d, item in enumerate(ids):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    n = min(window, b - a)
                    rows += [{"item_id": item, "n": n, "run": words.run(i, n)} for i in range(a, b - n + 1) if n]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("run", pa.binary())]))

    windows = written(bench.mapInArrow(item_windows, "item_id string, n int, run binary").distinct(), "bench-windows")
    lengths = sorted(r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect())
    as_text = windows.select("item_id", F.col("run").cast("string").alias("text"))
    schema = "at int, n int, print bigint"
    ours = as_text.mapInArrow(lambda it: prints(it, lengths), f"id string, {schema}").select("n", "print").distinct()
    key = written(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    numbered = key.select(F.col("row").alias("id"), "text")
    theirs = numbered.mapInArrow(lambda it: prints(it, lengths), f"id bigint, {schema}")
    near = theirs.join(ours, ["n", "print"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("n", "at")).alias("near"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                rows = []
                for d, (row, hits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    places = set()
                    for x in hits:
                        lo, hi = (x["at"] - w + 1, x["at"]) if x["n"] == window else (x["at"], x["at"])
                        places |= {(i, x["n"]) for i in range(max(lo, 0), hi + 1) if i + x["n"] <= b - a}
                    rows += [{"row": row, "at": i, "n": n, "run": words.run(a + i, n)} for i, n in sorted(places)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("run", pa.binary())]))

    pairs = numbered.join(near, "id").select("id", "text", "near").mapInArrow(candidates, "row bigint, at int, n int, run binary")
    met = pairs.join(windows, ["n", "run"]).groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("found"), F.collect_set("item_id").alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                counts = np.diff(words.first).tolist()
                yield pa.RecordBatch.from_pylist([_row(doc, counts[d], [(x["at"], x["n"]) for x in found or []], set(items or [])) for d, (doc, found, items) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()))], schema=_ARROW)

    return key.join(met, "row", "left").select("doc_id", "text", "found", "items").mapInArrow(finish, SCHEMA)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
