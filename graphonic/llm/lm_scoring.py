"""Language-model scoring by masked pseudo-likelihood.

A window network reads the two words on either side of a masked word and
predicts that word; the sum of the log-probabilities of all words of a document
is its pseudo-log-likelihood.

The vocabulary is exact and grows with the input: 64-bit hashes of all words of
all documents with their counts, a table in the shared folder that is joined and
never collected.  The network predicts one of ``GROUPS * SIZE`` leaves in two
steps, the group and then the leaf in the group; groups hold words of like
neighbours.  The most frequent words are leaves of their own.  The others share
leaves by their last three bytes, and the share of a word in its leaf is its
count over the count of the leaf, so the probabilities of all words of the
vocabulary sum to 1.  Words of at least ``threshold`` occurrences (at most
``KNOWN`` of them) are looked up in place, the rarer ones by a join.

Encoded documents are dealt to shards of about ``SHARD`` words by a hash of the
row, in a fixed order.  Each shard trains the network, in numpy, on all its words
from the same start, and the shards' parameters are averaged as whole numbers, so
the scores do not depend on how many tasks or cores there are.

Defined results: a null or empty text has no words, a sum of 0 and a null mean;
very long texts are read whole; repeated rows are scored each, alike; of words
with one count the smaller hash comes first; an empty table gives no rows; other
columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, ROW, byte_prefix, slices, span_hash, spans, table, text_bytes, written

GROUPS, SIZE = 64, 64
SHARED = 256
LEAVES = GROUPS * SIZE
OWN = LEAVES - SHARED
KNOWN = 1 << 16
HIDDEN, BATCH, RATE, ROUNDS = 16, 8192, 0.1, 1
PLACES = (-2, -1, 1, 2)
#: Words of a shard, and the most partitions that shards are written to.
SHARD, PARTITIONS = 1 << 21, 1 << 16
#: Frequent words whose places beside a word tell its group.
MARKS = 32
#: Leaf of the padding before a text's first and after its last word.
PAD = LEAVES
#: Words that a task counts before it sends them on.
HELD = 1_000_000
#: Fraction bits of a parameter, and words of one unit of weight, when shards are averaged.
FRACTION, UNIT = 20, 1 << 16


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a column's texts, the classes of their endings, and each text's first word."""
    raw, offsets = text_bytes(column)
    lower = LOWER[raw]
    start, end, first = spans(ALNUM[lower], offsets)
    prefix = byte_prefix(lower)
    ending = span_hash(prefix, np.maximum(start, end - 3), end) % np.uint64(SHARED)
    return span_hash(prefix, start, end).view(np.int64), ending.astype(np.int16), first


def summed(word: np.ndarray, ending: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each word, with the sum of its counts."""
    order = np.argsort(word, kind="stable")
    word, ending, n = word[order], ending[order], n[order]
    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    return word[at], ending[at], np.add.reduceat(n, at) if len(at) else n


def counted(docs: DataFrame) -> DataFrame:
    """word (hash), ending, n of every word of all texts, written."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["word", "ending", "n"])

        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                word, ending, _ = words_of(batch.column(0))
                held.append(summed(word, ending, np.ones(len(word), np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield sent(held[0])
                        held, size = [], 0
        if held:
            yield sent(summed(*map(np.concatenate, zip(*held))))

    rows = docs.select("text").mapInArrow(kernel, "word bigint, ending smallint, n bigint")
    return written(rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "lm-words")


@dataclass
class Vocabulary:
    """The words of at least ``threshold`` occurrences by hash, with leaf and count, and the counts of shared leaves."""

    threshold: int
    total: int
    word: np.ndarray
    leaf: np.ndarray
    n: np.ndarray
    shared: np.ndarray

    @staticmethod
    def of(counts: DataFrame, known: int = KNOWN, own: int = OWN) -> Vocabulary:
        levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.min("n").alias("least"), F.count("*").alias("words"))
        threshold, words = np.iinfo(np.int64).max, 0
        for level in sorted(levels.collect(), key=lambda r: -r.level):
            words += level.words
            if words > known:
                break
            threshold = level.least
        frequent = counts.where(F.col("n") >= threshold).select("word", "ending", "n").toArrow()
        word, ending, n = (c.to_numpy() for c in frequent.columns)
        order = np.lexsort((word, -n))
        leaf = OWN + ending.astype(np.int16)
        leaf[order[:own]] = np.arange(min(own, len(order)))
        shared = np.zeros(SHARED, np.int64)
        for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
            shared[r.ending] = r.n
        total = int(shared.sum())
        alone = order[:own]
        np.subtract.at(shared, ending[alone], n[alone])
        by = np.argsort(word)
        return Vocabulary(int(threshold), total, word[by], leaf[by], n[by], shared)

    def encoded(self, word: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its leaf, its count (0: to be joined), and the count of its leaf where that is shared (else 1, count 1)."""
        leaf, n = (OWN + ending).astype(np.int16), np.zeros(len(word), np.int64)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
            met = self.word[at] == word
            leaf[met], n[met] = self.leaf[at[met]], self.n[at[met]]
        return leaf, n, np.where(leaf < OWN, np.maximum(n, 1), self.shared[np.maximum(leaf - OWN, 0)])


ENCODED = "doc_id bigint, n_words bigint, leaves binary, share double, once bigint, rare array<struct<word:bigint,n:int>>"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each document as leaves, with the log-share of its known words and the list of its rarer ones; dealt to shards and written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pair = pa.struct([("word", pa.int64()), ("n", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                word, ending, first = words_of(batch.column(1))
                leaf, n, of = shared.value.encoded(word, ending)
                share = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n, 1) / of))])
                once = np.concatenate([[0], np.cumsum(n == 1)])
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))[n == 0]
                rare = word[n == 0]
                order = np.lexsort((rare, row))
                row, rare = row[order], rare[order]
                at = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.r_[at, len(row)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(rare[at]), pa.array(times)], fields=list(pair)))
                leaves = pa.array([leaf[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), leaves, pa.array(share[first[1:]] - share[first[:-1]]), pa.array(once[first[1:]] - once[first[:-1]]), lists], names=["doc_id", "n_words", "leaves", "share", "once", "rare"])

    shards = max(1, -(-vocabulary.total // SHARD))
    key = F.xxhash64("doc_id", "leaves")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(kernel, ENCODED).withColumn(ROW, F.monotonically_increasing_id())
    dealt = rows.withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)))
    return written(dealt.repartition(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard", "key", "doc_id").drop("key"), "lm-encoded")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of a column of documents, one after another, and each document's first."""
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), np.int16), offsets // 2


def contexts(leaf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the leaf of the word there, within the text."""
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    at = np.arange(len(leaf))
    out = np.full((len(PLACES), len(leaf)), PAD, np.int16)
    for k, p in enumerate(PLACES):
        inside = (at + p >= begin) & (at + p < end)
        out[k, inside] = leaf[at[inside] + p]
    return out


def neighbours(rows: DataFrame) -> np.ndarray:
    """How often each of the MARKS most frequent words stands before, and after, each leaf; over all documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEAVES * 2 * MARKS, np.int64)
        for batch in batches:
            leaf, first = joined(batch.column(0))
            around = contexts(leaf, first)
            for side, c in enumerate((around[1], around[2])):
                met = c < MARKS
                total += np.bincount(leaf[met].astype(np.int64) * 2 * MARKS + side * MARKS + c[met], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    found = rows.select("leaves").mapInArrow(kernel, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEAVES * 2 * MARKS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(LEAVES, 2 * MARKS)


def grouped(beside: np.ndarray) -> np.ndarray:
    """Slot of each leaf: leaves halved along the direction in which their neighbours differ most, until groups are full."""
    x = np.sqrt(beside / np.maximum(beside.sum(axis=1, keepdims=True), 1))
    parts = [np.arange(len(beside))]
    while len(parts[0]) > SIZE:
        halves = []
        for part in parts:
            centred = x[part] - x[part].mean(axis=0)
            _, vectors = np.linalg.eigh(centred.T @ centred)
            direction = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
            by = part[np.lexsort((part, np.round(centred @ direction, 9)))]
            halves += [np.sort(by[: len(by) // 2]), np.sort(by[len(by) // 2 :])]
        parts = halves
    slot = np.zeros(len(beside), np.int16)
    slot[np.concatenate(parts)] = np.arange(len(beside))
    return slot


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials, in place, of each row's logits, held within what a float can sum, and their sums."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def chosen_logs(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one choice in each row."""
    z = h @ weights
    z += bias
    e, sums = exponentials(z)
    return np.log(e[np.arange(len(at)), at] / sums)


def softmax_errors(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities, less 1 at each row's choice."""
    z = h @ weights
    z += bias
    e, sums = exponentials(z)
    e *= (1 / sums)[:, None]
    e[np.arange(len(at)), at] -= 1
    return e


class Network:
    """Word vectors, scaled for each place and summed, a tanh layer, softmax over groups and over the leaves of a group."""

    def __init__(self, slot: np.ndarray, prior: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.slot = slot
        by = np.zeros(LEAVES)
        by[slot] = prior + 0.5
        by = by.reshape(GROUPS, SIZE)
        start = [
            rng.normal(0, 0.3, (LEAVES + 1, HIDDEN)),
            rng.normal(0, 1.0, (len(PLACES), HIDDEN)),
            rng.normal(0, 0.1, (HIDDEN, GROUPS)),
            np.log(by.sum(axis=1) / by.sum()),
            rng.normal(0, 0.1, (GROUPS, HIDDEN, SIZE)),
            np.log(by / by.sum(axis=1, keepdims=True)),
        ]
        self.parts = [p.astype(np.float32) for p in start]
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            self.squares[k] = np.full(p.shape, 1e-3, np.float32)
            at += p.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        vectors, places = self.parts[:2]
        return np.tanh(sum(vectors.take(c, axis=0) * places[k] for k, c in enumerate(around)))

    def by_group(self, leaf: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the words by group, and where each group's words are in it."""
        group = (self.slot[leaf] // SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(GROUPS + 1))
        return order, [(g, slice(a, b)) for g, a, b in zip(range(GROUPS), cut[:-1].tolist(), cut[1:].tolist()) if a < b]

    def logs(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The log-probability of each leaf between its neighbours."""
        order, groups = self.by_group(leaf)
        h = self.hidden(around.take(order, axis=1))
        group, member = np.divmod(self.slot[leaf[order]].astype(np.int64), SIZE)
        _, _, first, first_bias, second, second_bias = self.parts
        found = chosen_logs(h, first, first_bias, group).astype(np.float64)
        for g, rows in groups:
            found[rows] += chosen_logs(h[rows], second[g], second_bias[g], member[rows])
        out = np.zeros(len(leaf))
        out[order] = found
        return out

    def gradients(self, around: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
        """Gradients of the negative mean log-probability of a batch."""
        n = len(leaf)
        order, groups = self.by_group(leaf)
        around, leaf = around.take(order, axis=1).astype(np.int64), leaf[order]
        group, member = np.divmod(self.slot[leaf].astype(np.int64), SIZE)
        vectors, places, first, first_bias, second, second_bias = self.parts
        ones = np.ones(n, first.dtype)
        h = self.hidden(around)
        d = softmax_errors(h, first, first_bias, group)
        dh = d @ first.T
        out = [np.zeros_like(p) for p in self.parts]
        out[2], out[3] = h.T @ d, ones @ d
        for g, rows in groups:
            e = softmax_errors(h[rows], second[g], second_bias[g], member[rows])
            out[4][g], out[5][g] = h[rows].T @ e, ones[rows] @ e
            dh[rows] += e @ second[g].T
        dh *= 1 - h * h
        for k, c in enumerate(around):
            out[1][k] = np.einsum("ij,ij->j", vectors.take(c, axis=0), dh)
        words = around.ravel()
        for j, column in enumerate(np.ascontiguousarray(dh.T)):
            out[0][:, j] = np.bincount(words, np.outer(places[:, j], column).ravel(), len(vectors))
        return [g / n for g in out]

    def step(self, around: np.ndarray, leaf: np.ndarray, rate: float = RATE) -> None:
        """One step of AdaGrad on a batch."""
        for p, s, g in zip(self.parts, self.squares, self.gradients(around, leaf)):
            s += (g * 100) ** 2
            p -= rate * 100 * g / np.sqrt(s)


def trained(rows: DataFrame, network: Network, rounds: int = ROUNDS) -> Network:
    """Rounds of training in every shard and averaging over all of them."""
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((network.slot, network.flat()))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            slot, flat = shared.value
            own = Network(slot, np.zeros(LEAVES))
            total, weight = np.zeros(len(flat), np.int64), 0
            for _, parts in shard_runs(batches):
                own.load(flat)
                seen = 0
                for around, leaf in steps(parts):
                    own.step(around, leaf)
                    seen += len(leaf)
                if seen:
                    units = max(1, round(seen / UNIT))
                    total += np.round(own.flat().astype(np.float64) * (1 << FRACTION)).astype(np.int64) * units
                    weight += units
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(total), pa.array(np.full(len(flat), weight, np.int64))], names=["at", "x", "n"])

        found = rows.select("shard", "leaves").mapInArrow(kernel, "at int, x bigint, n bigint").groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
        if found.num_rows:
            flat = np.zeros(len(network.flat()))
            flat[found.column(0).to_numpy()] = found.column(1).to_numpy() / found.column(2).to_numpy() / (1 << FRACTION)
            network.load(flat)
    return network


def shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Array]]]:
    """The runs of rows of one shard, each as an iterator over its columns of leaves, to be read to its end."""
    import itertools

    def pieces():
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
            for a, b in zip(cut[:-1], cut[1:]):
                yield int(shard[a]), batch.column(1).slice(a, b - a)

    for shard, run in itertools.groupby(pieces(), key=lambda p: p[0]):
        yield shard, (column for _, column in run)


def steps(columns: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of neighbours and words, of BATCH words but for the last, wherever the columns are cut."""
    around, leaf = np.zeros((len(PLACES), 0), np.int16), np.zeros(0, np.int16)
    for column in columns:
        more, first = joined(column)
        around, leaf = np.concatenate([around, contexts(more, first)], axis=1), np.concatenate([leaf, more])
        full = len(leaf) // BATCH * BATCH
        for k in range(0, full, BATCH):
            yield around[:, k : k + BATCH], leaf[k : k + BATCH]
        around, leaf = around[:, full:], leaf[full:]
    if len(leaf):
        yield around, leaf


def scored(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_words, n_once (of these, words that occur nowhere else), log_likelihood (summed), mean_log_likelihood of each row."""
    shared = rows.sparkSession.sparkContext.broadcast((network.slot, network.flat()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, flat = shared.value
        own = Network(slot, np.zeros(LEAVES)).load(flat)
        for whole in batches:
            for batch in slices(whole, "leaves"):
                leaf, first = joined(batch.column(1))
                around, logs = contexts(leaf, first), np.zeros(len(leaf))
                for k in range(0, len(leaf), 2 * BATCH):
                    logs[k : k + 2 * BATCH] = own.logs(around[:, k : k + 2 * BATCH], leaf[k : k + 2 * BATCH])
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[first[1:]] - sums[first[:-1]])], names=[ROW, "logs"])

    network_logs = rows.select(ROW, "leaves").mapInArrow(kernel, f"{ROW} bigint, logs double")
    words = rows.select(ROW, F.explode("rare").alias("w")).select(ROW, "w.word", F.col("w.n").alias("times"))
    few = counts.where(F.col("n") < vocabulary.threshold).select("word", F.col("n").alias("total"))
    rare = words.join(few, "word").groupBy(ROW).agg(F.sum(F.col("times") * F.log("total")).alias("rare_logs"), F.sum(F.when(F.col("total") == 1, F.col("times")).otherwise(0)).alias("rare_once"))
    found = rows.select(ROW, "doc_id", "n_words", "share", "once").join(network_logs, ROW).join(rare, ROW, "left")
    total = F.when(F.col("n_words") > 0, F.col("logs") + F.col("share") + F.coalesce("rare_logs", F.lit(0.0))).otherwise(F.lit(0.0))
    found = found.select("doc_id", "n_words", (F.col("once") + F.coalesce("rare_once", F.lit(0))).alias("n_once"), total.alias("log_likelihood"))
    return found.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Learn from all of docs and score each row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = counted(docs)
    vocabulary = Vocabulary.of(counts)
    rows = encoded(docs, vocabulary)
    return scored(rows, counts, vocabulary, trained(rows, started(rows, vocabulary), rounds))


def started(rows: DataFrame, vocabulary: Vocabulary) -> Network:
    """The untrained network: groups by neighbours, biases by the counts of all leaves."""
    prior = np.zeros(LEAVES)
    own = vocabulary.leaf < OWN
    prior[vocabulary.leaf[own]] = vocabulary.n[own]
    prior[OWN:] = vocabulary.shared
    return Network(grouped(neighbours(rows)), prior)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
