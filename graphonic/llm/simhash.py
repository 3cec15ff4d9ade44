"""Near-duplicate groups by SimHash and anchor-point covering.

The fingerprint is the bitwise majority over XXH64 hashes of word shingles.
Two blocks of 23 bits are covered by the binary Golay code and one of 15 bits
by a Hamming code.  Both are perfect: every word lies within 3 (or 1) of
exactly one codeword.  The anchors are triples of codewords (2^35), so few
fingerprints meet at one, at any size of the table.  A fingerprint's *home* is
the anchor with its nearest codewords; it is also *replicated* to every anchor
within covering radius plus threshold.  If two fingerprints differ in at most
``threshold`` bits, the home of one is within radius plus what differs in each
block of the other, so every link shows at a home; there the two are compared
in full.

Copies are merged first: only distinct fingerprints are covered, so a group of
exact copies, however large, is one row.  Links between distinct fingerprints
become components by alternating large-star and small-star steps, each cut by
a written table in the shared folder.

``similar`` finds near copies by what their words share: several fingerprints
a text propose candidates at the anchors of the two Golay blocks, and an exact
check of the five-word shingles decides.

Defined results: null or empty texts have the fingerprint zero and are linked
like any other; fewer words than a shingle are one shingle; rows that repeat
share their component; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SOLID, byte_prefix, mixed, ragged, slices, span_hash, spans, table, text_bytes, written

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: For ``similar``: fingerprints of a text, excess over the covering radius, fingerprints that are compared at an anchor and
#: the bits in which they may differ together (similarity 0.8 is at 28 of 256, with a deviation of 5).
PRINTS, EXCESS, SHOWN, MOST_BITS = 8, 1, 4, 45
#: For ``similar``: words of a shingle and the least Jaccard similarity of a link.
WORDS, LEAST = 5, 0.8
#: Rows of one anchor that are compared at once; a larger anchor is compared in pairs of blocks, each by a task.
BLOCK_ROWS = 20_000
#: Bytes of shingles of one candidate group that are compared at once; a larger group is compared in pairs of blocks.
BLOCK_BYTES = 16_000_000
#: Comparisons that one step within an anchor works on, and rows of an anchor up to which all its pairs are compared at once.
STEP, FEW = 1_000_000, 16


def _shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of each text, and how many shingles each text has."""
    raw, offsets = text_bytes(column)
    start, end, first = spans(SOLID[raw], offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    # The words again, each followed by one space: a shingle is then a plain slice.
    size = end - start
    to = np.cumsum(size + 1)
    joined = np.full(to[-1], 32, np.uint8)
    joined[ragged(to - size - 1, size)] = LOWER[raw][ragged(start, size)]
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = ragged(first[:-1], count)
    last = begin + np.repeat(np.minimum(words, n), count) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip((to[begin] - size[begin] - 1).tolist(), (to[last] - 1).tolist())), np.uint64, len(begin))
    return h, count


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes."""
    out = np.zeros(len(count), np.uint64)
    at = np.cumsum(count) - count
    for k in np.flatnonzero(count).tolist():
        m = int(count[k])
        votes = np.zeros(64, np.int64)
        for a in range(int(at[k]), int(at[k]) + m, 65536):
            bits = np.unpackbits(h[a : min(a + 65536, int(at[k]) + m)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > m, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(column: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text of a column."""
    return _majority(*_shingles(column, n))


class Shingles:
    """The different word shingles of each text of a column, as vectorised hashes."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        lower = LOWER[raw]
        start, end, self.first = spans(SOLID[lower], offsets)
        self.hash = span_hash(byte_prefix(lower), start, end)

    def sets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the different shingles of n words, text by text in order, and how many each text has.

        Fewer words than n are one shingle.
        """
        words = np.diff(self.first)
        count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        begin, row = ragged(self.first[:-1], count), np.repeat(np.arange(len(words)), count)
        last = self.first[1:][row]
        h = np.zeros(len(begin), np.uint64)
        for k in range(n):
            at = begin + k
            inside = at < last
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, self.hash[np.minimum(at, max(len(self.hash) - 1, 0))], np.uint64(0))
        h = mixed(h)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
        return h[new], np.bincount(row[new], minlength=len(words))


def several_fingerprints(shingles: Shingles, prints: int, n: int = SHINGLE) -> np.ndarray:
    """Several independent SimHashes of each text, a row a text: its different shingles, mixed anew for each."""
    h, count = shingles.sets(n)
    return np.stack([_majority(mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), count) for k in range(prints)], axis=1)


def set_hashes(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash of each text's set of shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h), dtype=np.uint64)])
    to = np.cumsum(count)
    return mixed(sums[to] - sums[to - count] + count.astype(np.uint64))


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code over a block of ``width`` bits: every word is within ``radius`` of exactly one codeword."""

    width: int
    degree: int
    generator: int
    radius: int

    @cached_property
    def syndrome(self) -> np.ndarray:
        """The remainder of each word by the generator polynomial."""
        out = np.zeros(1 << self.width, np.uint16)
        for bit in range(self.width):
            x = 1 << bit
            for k in range(self.width - 1, self.degree - 1, -1):
                if x >> k & 1:
                    x ^= self.generator << (k - self.degree)
            out[1 << bit : 2 << bit] = out[: 1 << bit] ^ np.uint16(x)
        return out

    @cached_property
    def errors(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By excess 0, 1, 2 over the radius: error words in order of syndrome, the first of each syndrome, their number."""
        out = []
        for excess in range(THRESHOLD + 1):
            weights = range(self.radius + 1) if not excess else (self.radius + excess,)
            words = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(self.width), w)], np.uint32)
            found = self.syndrome[words]
            order = np.argsort(found, kind="stable")
            first = np.searchsorted(found[order], np.arange((1 << self.degree) + 1))
            out.append((words[order], first[:-1], np.diff(first)))
        return out


#: The binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1, and the Hamming code of 15 bits, x^4+x+1 (fixed values).
GOLAY, HAMMING = Code(23, 11, 0b101011100011, 3), Code(15, 4, 0b10011, 1)
#: The blocks of a fingerprint, from its lowest bit on; ``similar`` uses the first two.
CODES, LOOSE_CODES = (GOLAY, GOLAY, HAMMING), (GOLAY, GOLAY)


def _blocks(fp: np.ndarray, codes: tuple[Code, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for code in codes:
        out.append(((fp >> np.uint64(at)) & np.uint64((1 << code.width) - 1)).astype(np.uint32))
        at += code.width
    return out


def homes(fp: np.ndarray, codes: tuple[Code, ...] = CODES) -> np.ndarray:
    """The anchor nearest to each fingerprint."""
    out = np.zeros(len(fp), np.int64)
    for code, block in zip(codes, _blocks(fp, codes)):
        words, first, _ = code.errors[0]
        out = out << code.width | block ^ words[first[code.syndrome[block]]]
    return out


def covering(fp: np.ndarray, threshold: int = THRESHOLD, codes: tuple[Code, ...] = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for every anchor within covering radius plus threshold."""
    blocks = _blocks(fp, codes)
    syndromes = [code.syndrome[block] for code, block in zip(codes, blocks)]
    rows, anchors = [], []
    for excess in product(range(threshold + 1), repeat=len(codes)):
        if sum(excess) > threshold:
            continue
        near = [code.errors[e] for code, e in zip(codes, excess)]
        counts = np.ones(len(fp), np.int64)
        for (_, _, n), s in zip(near, syndromes):
            counts = counts * n[s]
        row = np.repeat(np.arange(len(fp)), counts)
        k = ragged(np.zeros(len(fp), np.int64), counts)
        anchor = np.zeros(len(row), np.int64)
        for code, block, s, (words, first, n) in zip(codes, blocks, syndromes, near):
            k, place = np.divmod(k, n[s[row]])
            anchor = anchor << code.width | block[row] ^ words[first[s[row]] + place]
        rows.append(row)
        anchors.append(anchor)
    return np.concatenate(rows), np.concatenate(anchors)


def fingerprint_table(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), n).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id bigint, fp bigint")


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, of distinct fingerprints that differ in 1 to threshold bits.

    The planner sees as many replicas as fingerprints, as a kernel's rows are
    not known to it, and would broadcast them: the join is told to shuffle.
    """

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(homes(fp.view(np.uint64))), pa.array(fp)], names=["anchor", "a"])

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 5000):
                part = np.ascontiguousarray(fp[k : k + 5000])
                row, anchor = covering(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], names=["anchor", "b"])

    home = distinct.select("fp").mapInArrow(at_home, "anchor bigint, a bigint")
    probe = distinct.select("fp").mapInArrow(replicated, "anchor bigint, b bigint")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.alias("h").hint("merge").join(probe.alias("p"), (F.col("h.anchor") == F.col("p.anchor")) & close).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the edges (a, b) from which a smaller one is reachable: the smallest.

    Alternating large-star and small-star steps; the smallest neighbour comes
    from an aggregation, so a node with many neighbours is not gathered in
    one task.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its group) of each row of docs."""
    own = written(fingerprint_table(docs, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    pairs = links(distinct, threshold)
    # A row for each fingerprint is not broadcast either: as a hash table it is many times its file.
    rep = lambda fp, name: distinct.select(F.col("fp").alias(fp), F.col("rep").alias(name)).hint("merge")
    named = pairs.join(rep("a", "ra"), "a").join(rep("b", "rb"), "b")
    found = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left")


class _Forest:
    """Union-find that says which links join what was apart."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _close_rows(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join rows differing in at most ``most`` bits into the groups that all such pairs make.

    Each row reached is in turn compared with all rows that are not reached
    yet, so no pair that could join two groups is left out, and a group of
    near copies of its first row costs one step.
    """
    columns = np.ascontiguousarray(fps.T)
    left, reached = np.arange(len(fps)), np.zeros(0, np.int64)
    while len(left):
        if not len(reached):
            reached, left = left[:1], left[1:]
        n = max(1, STEP // max(1, len(left)))
        now, reached = reached[:n], reached[n:]
        bits = np.zeros((len(now), len(left)), np.int16)
        for column in columns:
            bits += np.bitwise_count(column[now][:, None] ^ column[left])
        near = bits <= most
        hit = near.any(axis=0)
        yield now[near.argmax(axis=0)[hit]], left[hit]
        reached, left = np.concatenate([reached, left[hit]]), left[~hit]


def _close_pairs(key: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one key that differ in at most ``most`` bits, for keys of at most FEW rows; rows are sorted by key."""
    for shift in range(1, FEW):
        i = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(i):
            return
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]).sum(axis=1, dtype=np.int64) <= most]
        yield i, i + shift


def _alike(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links that join sets into the groups that all pairs of a Jaccard similarity of ``least`` or more make.

    Sets are searched as in ``_close_rows``.  Those that can be alike share
    one of the rarest shingles (prefix filtering); of these the similarity is
    computed exactly.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    ids = ids[np.lexsort((ids, often[ids], row))]  # each set's rarest first
    start = np.cumsum(sizes) - sizes
    parts = [ids[a : a + n] for a, n in zip(start.tolist(), sizes.tolist())]
    unreached, marked = np.ones(len(sets), bool), np.zeros(len(often), bool)
    queue: list[int] = []
    while (left := np.flatnonzero(unreached)).size:
        # An index of what is unreached, made anew when half of it is reached.
        held = np.concatenate([parts[i] for i in left.tolist()])
        order = np.argsort(held, kind="stable")
        first = np.searchsorted(held[order], np.arange(len(often) + 1))
        rows = np.repeat(left, sizes[left])[order]
        remaining = len(left)
        while 2 * remaining >= len(left) and remaining:
            if not queue:
                queue = [int(left[unreached[left].argmax()])]
                unreached[queue[0]] = False
                remaining -= 1
            i = queue.pop()
            prefix = parts[i][: sizes[i] - math.ceil(least * sizes[i] - 1e-9) + 1]
            near = np.unique(rows[ragged(first[prefix], first[prefix + 1] - first[prefix])]) if len(prefix) else rows[:0]
            near = near[unreached[near] & (sizes[near] >= least * sizes[i] - 1e-9) & (sizes[i] >= least * sizes[near] - 1e-9)]
            if not len(near):
                continue
            marked[parts[i]] = True
            shared = np.add.reduceat(marked[np.concatenate([parts[j] for j in near.tolist()])].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            marked[parts[i]] = False
            hit = near[shared >= least * (sizes[i] + sizes[near] - shared) - 1e-9].tolist()
            yield from ((i, j) for j in hit)
            unreached[hit] = False
            remaining -= len(hit)
            queue += hit


def _runs(rows: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal rows."""
    if not len(rows):
        return []
    cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1), True]).tolist()
    return list(zip(cut[:-1], cut[1:]))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, int | None]]:
    """Rows sorted by their first column, as (rows of whole keys, None) or (part of a key of over ``most`` rows, number of the part)."""
    rows, large, block = None, None, 0
    for batch in batches:
        more = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns], axis=1)
        rows = more if rows is None else np.concatenate([rows, more])
        while len(rows):
            if large is not None:
                end = int(np.searchsorted(rows[:, 0], large, side="right"))
                if end == len(rows) and end < most:
                    break
                if end:
                    yield rows[: min(end, most)], block
                    block += 1
                if end < min(len(rows), most + 1):
                    large = None
                rows = rows[min(end, most) :]
                continue
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last key may go on
            if whole:
                yield rows[:whole], None
                rows = rows[whole:]
            if len(rows) <= most:
                break
            large, block = rows[0, 0], 0
    if rows is not None and len(rows):
        yield rows, None if large is None else block


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that agree in the first columns, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        found = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        for a, b in _runs(found):
            if (key := found[a].tolist()) != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _in_pairs(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with block and blocks (of their key) at every pair (lo, hi) of their key's blocks, sorted by key, lo, hi.

    A key of one block is the pair (0, 0); of several, a row meets its own
    block's rows in each pair.
    """
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: (k != F.col("block")) | (F.col("blocks") == 1))
    out = rows.withColumn("other", F.explode(other)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return out.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi").select(key, "lo", "hi", *columns)


def _joining(found: Iterator[tuple[int, int]], forest: _Forest) -> pa.RecordBatch:
    """The links that join what the forest has apart."""
    new = [x for x in found if forest.joins(*x)]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], names=["a", "b"])


def candidates(distinct: DataFrame, prints: int = PRINTS, excess: int = EXCESS, shown: int = SHOWN, most_bits: int = MOST_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that join rows of ``distinct`` (rep, f0, f1, ...) which an anchor brings together and few bits tell apart.

    All fingerprints have anchors; the first ``shown`` travel and are compared.  A task streams its anchors; one of more than ``block_rows`` rows is passed
    on in blocks, and every pair of its blocks is compared by itself.
    """
    names = [f"f{k}" for k in range(shown)]
    columns = ", ".join(f"{x} bigint" for x in names)
    width = sum(code.width for code in LOOSE_CODES)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for f in range(prints):
                    row, anchor = covering(np.ascontiguousarray(part.column(f).to_numpy(zero_copy_only=False)).view(np.uint64), excess, LOOSE_CODES)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.int64(f) << np.int64(width) | anchor), *(part.column(k).take(take) for k in (*range(shown), prints))], names=["key", *names, "rep"])

    def links_of(rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links within the runs of one key; rows are (key, fingerprints, rep)."""
        runs = np.array(_runs(rows[:, :1]))
        size = runs[:, 1] - runs[:, 0]
        few = rows[np.repeat(size <= FEW, size)]
        for i, j in _close_pairs(few[:, 0], np.ascontiguousarray(few[:, 1:-1]).view(np.uint64), most_bits):
            yield from zip(few[i, -1].tolist(), few[j, -1].tolist())
        for a, b in runs[size > FEW].tolist():
            for i, j in _close_rows(np.ascontiguousarray(rows[a:b, 1:-1]).view(np.uint64), most_bits):
                yield from zip(rows[a + i, -1].tolist(), rows[a + j, -1].tolist())

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        schema = ["a", "b", "key", *names, "rep", "block"]
        for rows, block in _chunks(batches, block_rows):
            if block is None:
                found = _joining(links_of(rows), forest)
                none = pa.nulls(found.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*found.columns, *[none] * (shown + 3)], names=schema)
            else:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, np.ascontiguousarray(rows.T)), pa.array(np.full(len(rows), block, np.int64))], names=schema)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for group in _groups(batches, 3):
            yield _joining(links_of(np.stack([group.column(k).to_numpy() for k in (0, *range(3, shown + 4))], axis=1)), forest)

    rows = distinct.select(*[f"f{k}" for k in range(prints)], "rep").mapInArrow(anchored, f"key bigint, {columns}, rep bigint")
    first = written(rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(linked, f"a bigint, b bigint, key bigint, {columns}, rep bigint, block bigint"), "candidates")
    over = first.where("key is not null").drop("a", "b")
    over = over.join(over.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "key")
    second = _in_pairs(over, "key", [*names, "rep"]).mapInArrow(of_pairs, "a bigint, b bigint")
    return first.where("a is not null").select("a", "b").unionAll(second)


def verified(groups: DataFrame, words: int = WORDS, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links that join rows of ``groups`` (rep, component, text) of one component whose shingles are alike.

    Only (component, shingles) travel.  A component of over ``block_bytes`` is
    dealt into blocks, and every pair of its blocks is compared by itself.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, count = Shingles(batch.column(2)).sets(words)
                cut = np.concatenate([[0], np.cumsum(count)]).tolist()
                sets = pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["rep", "component", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for group in _groups(batches, 3):
            reps = group.column(3).to_pylist()
            found = _alike([np.frombuffer(x, np.uint64) for x in group.column(4).to_pylist()], least)
            yield _joining(((reps[i], reps[j]) for i, j in found), forest)

    sets = written(groups.select("rep", "component", "text").mapInArrow(shingled, "rep bigint, component bigint, shingles binary"), "shingles")
    blocks = sets.groupBy("component").agg(F.ceil(F.sum(F.octet_length("shingles")) / F.lit(block_bytes)).cast("bigint").alias("blocks"))
    dealt = sets.join(blocks.withColumn("blocks", F.greatest("blocks", F.lit(1))), "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return _in_pairs(dealt, "component", ["rep", "shingles"]).mapInArrow(compared, "a bigint, b bigint")


def similar(docs: DataFrame, prints: int = PRINTS, excess: int = EXCESS, shown: int = SHOWN, most_bits: int = MOST_BITS, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of each row, for texts that share most of their shingles.

    Each text has several independent fingerprints.  Texts that share an
    anchor within covering radius plus excess in any of them, and differ in at
    most ``most_bits`` bits of the ``shown`` first, become candidate groups; within these,
    texts are linked whose sets of shingles have a Jaccard similarity of
    ``least`` or more, computed exactly.  Texts of one set of shingles are one
    row from the start, and a task sends on only links that join what it had
    apart.  ``doc_id`` is distinct.
    """
    names = [f"f{k}" for k in range(prints)]

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles = Shingles(batch.column(1))
                fps = several_fingerprints(shingles, prints).view(np.int64)
                same = set_hashes(*shingles.sets(words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), *map(pa.array, np.ascontiguousarray(fps.T))], names=["doc_id", "same", *names])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = written(docs.mapInArrow(fingerprinted, f"doc_id bigint, same bigint, {', '.join(f'{x} bigint' for x in names)}"), "fingerprints")
    distinct = written(own.groupBy("same", "f0").agg(F.min("doc_id").alias("rep"), *[F.first(x).alias(x) for x in names[1:]]), "distinct")
    near = components(candidates(distinct, prints, excess, shown, most_bits))
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    groups = docs.join(near.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    found = components(verified(groups, words, least))
    named = distinct.join(found, distinct.rep == found.node, "left").select("same", "f0", F.coalesce("component", "rep").alias("component_id"))
    return own.select("doc_id", "same", "f0").join(named, ["same", "f0"]).select("doc_id", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
