"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are turned into integers, floor(scale * x), and packed into blocks.
Within a bucket of blocks every dimension has a list of the vectors sorted by
that component.  Queries read all lists in step from both ends, together;
whatever a list shows for the first time is scored for every query that is
still open.  After each round the components at the lists' heads (the high end
where a query's own component is positive, else the low end) bound the score
of every vector not yet shown; a query is closed when that bound is below its
k-th best.  (An equal bound does not close it: ties go to the smaller vec_id.)
Nothing else stops a query: where the bound never falls, the lists are read to
their end.

A bucket's answer is exact, and the best of the buckets' answers are merged by
rank, so the whole is exact.  Query blocks are sent to every bucket; a bucket
is streamed, its candidates first, and what travels after is k rows a query
and bucket.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; only vectors of equal length are compared; rows that
repeat a vec_id are not candidates of a query of that id; fewer candidates
than k: all; an empty table gives no rows; other columns are unread.  Scores
are exact below 2**53 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, SCALE, FIRST_DEPTH = 20, 64, 8
#: Most vectors of a packed block of candidates and of queries, and vectors of a bucket.
BLOCK, QUERY_BLOCK, BUCKET = 8192, 512, 16_384
#: Queries that are scored together.
TOGETHER = 64

PACKED = "dim int, n int, width int, ids binary, parts binary"


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components as one run of 64-bit integers)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat)
    cum = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(offsets)
    rows = np.flatnonzero((cum[offsets[1:]] == cum[offsets[:-1]]) & (size > 0) & column.is_valid().to_numpy(zero_copy_only=False))
    keep = np.repeat(np.isin(np.arange(len(size)), rows), size)
    return rows, size[rows], np.floor(scale * flat[offsets[0] : offsets[-1]][keep]).astype(np.int64)


def blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """Vectors packed in place, up to ``rows`` of one length to a block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int, last: bool) -> Iterator[pa.RecordBatch]:
            ids, parts = (np.concatenate(x) for x in zip(*held[dim]))
            at = 0
            while len(ids) - at >= rows or last and at < len(ids):
                to = min(at + rows, len(ids))
                yield _packed(ids[at:to], parts[at:to])
                at = to
            held[dim] = [(ids[at:], parts[at:])]

        for batch in batches:
            found, size, flat = integers(batch.column(1), scale)
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)[found]
            starts = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                rows_of = np.flatnonzero(size == dim)
                held.setdefault(dim, []).append((ids[rows_of].astype(np.int64), flat[(starts[rows_of][:, None] + np.arange(dim))]))
                yield from packed(dim, False)
        for dim in held:
            yield from packed(dim, True)

    return vectors.mapInArrow(kernel, PACKED)


def _packed(ids: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """One block, its components in as few bytes as hold them."""
    most = max(int(parts.max()), -int(parts.min()))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1 or w == 8)
    return pa.RecordBatch.from_pydict({"dim": pa.array([parts.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids.tobytes()], "parts": [parts.astype(f"<i{width}").tobytes()]})


class Lists:
    """The sorted lists of one bucket."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], parts[by_id].astype(np.float64)
        self.order = np.argsort(self.values, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        #: Scores computed and vectors there, summed over queries.
        self.scored = self.offered = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, first: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best of the bucket for each query."""
        parts = [self._search(query_ids[at : at + TOGETHER], queries[at : at + TOGETHER].astype(np.float64), k, first) for at in range(0, len(query_ids), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3

    def _search(self, query_ids: np.ndarray, q: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, none = len(self.ids), np.iinfo(np.int64).min
        # score * n + (n - 1 - place): the greater of two is the better score, or the smaller vec_id.
        best = np.full((len(q), k), none)
        open_, shown = np.arange(len(q)), np.zeros(n, bool)
        before, depth = 0, min(first, n)
        self.offered += len(q) * n
        while len(open_):
            new = np.zeros(n, bool)
            new[self.order[before:depth]] = True
            new[self.order[n - depth : n - before]] = True
            new &= ~shown
            shown |= new
            rows = np.flatnonzero(new)
            self.scored += len(open_) * len(rows)
            score = np.rint(q[open_] @ self.values[rows].T).astype(np.int64) * n + (n - 1 - rows)
            score[self.ids[rows] == query_ids[open_][:, None]] = none
            both = np.concatenate([best[open_], score], axis=1)
            best[open_] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            if depth == n or shown.all():
                break
            bound = np.maximum(q[open_], 0) @ self.sorted[n - depth] + np.minimum(q[open_], 0) @ self.sorted[depth - 1]
            least = best[open_].min(axis=1)
            open_ = open_[(least == none) | (least // n <= bound)]
            before, depth = depth, min(depth * 4, n)
        at, place = np.nonzero(best != none)
        found = best[at, place]
        return query_ids[at], self.ids[n - 1 - found % n], found // n


def _search(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, dim, asks, width, ids, parts = (column[i].as_py() for column in batch.columns)
                if (bucket, dim) != now:
                    now, held, lists = (bucket, dim), [], None
                block = np.frombuffer(ids, np.int64), np.frombuffer(parts, f"<i{width}").reshape(-1, dim)
                if not asks:
                    held.append(block)
                elif held:
                    if lists is None:
                        lists = Lists(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    found = lists.search(*block, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return kernel


def _numbered(packed: DataFrame) -> tuple[DataFrame, int, int]:
    """Blocks with their number among all, how many there are, and how many vectors.

    A task's own numbers follow those of the tasks before it, whose counts (a
    row a task) are summed on the driver.
    """
    spark = packed.sparkSession
    place = F.monotonically_increasing_id()
    kept = written(packed.withColumn("place", place), "blocks")
    part = F.shiftrightunsigned("place", 33)
    counts = sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).collect(), key=lambda r: r.part)
    bases = np.cumsum([0, *(r.blocks for r in counts)]).tolist()
    base = spark.createDataFrame([(r.part, b) for r, b in zip(counts, bases)], "part bigint, base bigint")
    dense = kept.withColumn("part", part).join(base, "part").withColumn("number", F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    return dense.drop("part", "base", "place"), bases[-1], sum(r.n for r in counts)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products.

    Both tables have vec_id and embedding.
    """
    candidates, n_blocks, n_vectors = _numbered(blocks(vectors.select("vec_id", "embedding"), BLOCK, scale))
    # At least a bucket a core, so that all cores work; beyond that as few as the bound on a bucket allows.
    buckets = max(1, min(n_blocks, max(-(-n_vectors // BUCKET), vectors.sparkSession.sparkContext.defaultParallelism)))
    candidates = candidates.select((F.col("number") % buckets).alias("bucket"), "dim", F.lit(False).alias("asks"), "width", "ids", "parts")
    asked = written(blocks(queries.select("vec_id", "embedding"), QUERY_BLOCK, scale), "queries")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "dim", F.lit(True).alias("asks"), "width", "ids", "parts")
    rows = candidates.unionByName(asked).repartition("bucket", "dim").sortWithinPartitions("bucket", "dim", "asks")
    found = rows.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), q AS (SELECT vec_id AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v WHERE vec_id % 20 = 0
), c AS (SELECT vec_id, unnest(e) AS y, generate_subscripts(e, 1) AS d FROM v
), s AS (SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (d) WHERE query_id <> vec_id GROUP BY ALL
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
