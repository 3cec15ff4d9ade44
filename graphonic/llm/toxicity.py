"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the words' beginnings, hashed into buckets; a
text's features are the buckets that it has, whatever its length.  The machine
adds weights of single features and inner products of their factors, so it
learns pairs, such as an insult together with a mention of a group, that
additive weights miss.

It is fitted on at most ``sample`` labelled rows (the smallest hashes of
doc_id), a documented bound: only their ids and labels are broadcast and only
their features, of which the ``features`` with the strongest association stay,
reach the driver.  Scoring reads each text once, in place, whole.

Defined results: a null or empty text has no features and scores as the bias
alone; labels that are null are skipped; without any labelled row of both
kinds every score is the share of label 1 (0 without rows); rows that repeat
are scored each; extra columns pass the filter and are not read by the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, byte_prefix, slices, span_hash, spans, table, text_bytes

SAMPLE, BUCKETS, FEATURES, FACTORS, EPOCHS = 9_000, 1 << 20, 2048, 8, 12
#: Lengths, in bytes, of the beginnings of words that are terms beside the words.
BEGINNINGS = (3, 4, 5, 6)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each term of each text, with repeats."""
    raw, offsets = text_bytes(column)
    lower = LOWER[raw]
    start, end, first = spans(ALNUM[lower], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    prefix = byte_prefix(lower)
    rows, hashes = [row], [span_hash(prefix, start, end)]
    for n in BEGINNINGS:
        longer = end - start > n
        rows.append(row[longer])
        hashes.append(span_hash(prefix, start[longer], start[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    """A fitted factorization machine: place[bucket] is a feature's number plus one, or 0."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        row, bucket = terms(column)
        feature = self.place[bucket]
        met = feature > 0
        n = len(self.weights)
        pair = np.unique(row[met] * np.int64(max(n, 1)) + feature[met] - 1)
        return _sigmoid(self.logits(pair // max(n, 1), pair % max(n, 1), len(column)))

    def logits(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        out = np.full(rows, self.bias)
        out += np.bincount(row, self.weights[feature], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fit on (row, bucket) pairs, each once, and the rows' labels by AdaGrad with weight decay."""
    n, positive = len(label), int(label.sum())
    if not 0 < positive < n:
        share = min(max(positive / max(n, 1), 1e-9), 1 - 1e-9)
        return Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.int32), np.zeros(0), np.zeros((0, factors)))
    seen = np.bincount(bucket, minlength=BUCKETS).astype(float)
    toxic = np.bincount(bucket[label[row] == 1], minlength=BUCKETS)
    share = positive / n
    strength = np.where(seen >= 3, np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1), 0)
    chosen = np.argsort(-strength, kind="stable")[:features]
    chosen = chosen[strength[chosen] > 3]
    place = np.zeros(BUCKETS, np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)
    feature = place[bucket]
    met = feature > 0
    order = np.argsort(row[met], kind="stable")
    row, feature = row[met][order], feature[met][order] - 1
    del bucket, met, order
    first = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w0, w = float(np.log(share / (1 - share))), np.zeros(len(chosen))
    v = rng.normal(0, 0.02, (len(chosen), factors))
    g0, gw, gv = 1.0, np.full(len(chosen), 1.0), np.full(v.shape, 1.0)
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, 256):
            rows = shuffled[at : at + 256]
            x = np.zeros((len(rows), len(chosen)))
            for i, r in enumerate(rows.tolist()):
                x[i, feature[first[r] : first[r + 1]]] = 1
            s = x @ v
            z = w0 + x @ w + 0.5 * ((s * s).sum(1) - (x @ (v * v)).sum(1))
            e = _sigmoid(z) - label[rows]
            d0, dw = e.mean(), x.T @ e / len(rows) + 1e-5 * w
            dv = (x.T @ (e[:, None] * s) - (x.T @ e)[:, None] * v) / len(rows) + 1e-4 * v
            g0, gw, gv = g0 + 100 * d0 * d0, gw + 100 * dw * dw, gv + 100 * dv * dv
            w0 -= 2 * d0 / np.sqrt(g0)
            w -= 2 * dw / np.sqrt(gw)
            v -= 0.3 * dv / np.sqrt(gv)
    return Machine(w0, place, w, v)


def held_out(doc_id: Column) -> Column:
    """Whether a row is one of the fifth whose labels nothing learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taken = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    bounded = spark.createDataFrame([(r.doc_id, r.toxic) for r in taken], "doc_id bigint, toxic int")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, bucket = terms(batch.column(1))
                pair = np.unique(row * np.int64(BUCKETS) + bucket)
                cut = np.searchsorted(pair // BUCKETS, np.arange(batch.num_rows + 1))
                ids = (pair % BUCKETS).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])], names=["doc_id", "toxic", "buckets"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(bounded), "doc_id").select("doc_id", "text", "toxic")
    rows = sorted(joined.mapInArrow(kernel, "doc_id bigint, toxic int, buckets binary").collect(), key=lambda r: (r.doc_id, r.toxic, r.buckets))
    sizes = [len(r.buckets) // 4 for r in rows]
    label = np.array([r.toxic for r in rows], np.int64)
    bucket = np.frombuffer(b"".join(r.buckets for r in rows), "<i4")
    del rows
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), bucket, label)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id bigint, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                low = shared.value.scores(batch.column(batch.schema.get_field_index("text"))) < threshold
                yield batch.filter(pa.array(low))

    return docs.mapInArrow(kernel, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scored(docs, learned(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
