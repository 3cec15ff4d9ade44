"""Sharding by a k-d tree over document metadata.

The tree splits a node at the byte-weighted median along its widest metadata
dimension until ``shards`` leaves are reached (a power of two; each leaf then
holds about the target bytes).  Widths are compared as parts of the whole
table's range.  Equal values are told apart by doc_id, and rows of one doc_id
by a written row number, so that a dimension, or a doc_id, on which a third of
all rows agree still splits evenly.

Medians are exact up to the bytes of one document and are found by sums over
histograms: all nodes of a level at once, one narrow aggregation a round, with
at most ``BINS`` rows a node sent to the driver.  Texts are read once, for
their size and checksum.

Slots are dealt by range-partitioning on (shard, doc_id); a task's own row
numbers plus the counts of the tasks before it give gapless slots without
gathering a shard in one task.

Defined results: a null text has no bytes (size 1, checksum 0); null metadata
counts as the smallest value, a null doc_id as the smallest of all; repeated
doc_ids are rows of their own, which may part; an empty table gives no rows;
other columns are unread; very long texts are sized whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SHARDS, BINS = 16, 256
#: What stands for null: below any value.
LEAST = -(1 << 40)
#: Numbers of the named dimensions: size in bytes, hashed language and source, characters.
DIMENSIONS = ("size", "lang", "source", "n_chars")


def _case(node: Column, values: dict[int, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(node == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def _medians(rows: DataFrame, half: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node the smallest key v such that the rows with key <= v weigh at least half.

    ``rows`` has node, key (long) and size.  With v: what the rows before it
    weigh and what the rows at it weigh.
    """
    span = {r.node: [r.lo, r.hi, 0, r.w] for r in rows.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("w")).collect()}
    while live := {n: v for n, v in span.items() if v[1] > v[0]}:
        step = {n: -(-(v[1] - v[0] + 1) // BINS) for n, v in live.items()}
        low, high = (_case(F.col("node"), {n: v[k] for n, v in live.items()}, "bigint") for k in (0, 1))
        inside = rows.where(F.col("key").between(low, high))
        bins = inside.groupBy("node", F.floor((F.col("key") - low) / _case(F.col("node"), step, "bigint")).alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        found: dict[int, list] = {n: [] for n in live}
        for r in bins.collect():
            found[r.node].append((r.lo, r.hi, r.w))
        for n, parts in found.items():
            before = span[n][2]
            for lo, hi, w in sorted(parts):
                span[n] = [lo, hi, before, w]
                if before + w >= half[n]:
                    break
                before += w
    return {n: (lo, before, w) for n, (lo, _, before, w) in span.items()}


def kd_tree(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size and the other columns of docs with their leaf, 0 to shards - 1.

    ``docs`` has doc_id, size and long columns named by ``dimensions``; ``row``, a distinct long, if it is written already.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    rows = docs.select("*", F.lit(1).cast("long").alias("node"))
    if "row" not in docs.columns:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    whole = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).first()
    ranges = {d: max(whole[d] or 0, 1) for d in dimensions}
    for level in range(shards.bit_length() - 1):
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).collect()
        if not stats:
            break
        widest = {r.node: max(range(len(dimensions)), key=lambda k: (r[dimensions[k]] / ranges[dimensions[k]], -k)) for r in stats}
        half = {r.node: -(-r.w // 2) for r in stats}
        key = F.lit(None).cast("bigint")
        for k, d in enumerate(dimensions):
            nodes = [n for n, w in widest.items() if w == k]
            if nodes:
                key = F.when(F.col("node").isin(nodes), F.col(d)).otherwise(key)
        keyed = rows.withColumn("key", key)
        at = _medians(keyed.select("node", "key", "size"), half)
        here = _case(F.col("node"), {n: v for n, (v, _, _) in at.items()}, "bigint")
        # Rows that share the median value: the same search by doc_id, and then by row.
        ties = keyed.where(F.col("key") == here).select("node", F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), "row", "size")
        goal = {n: h - at[n][1] for n, h in half.items()}
        by_doc = _medians(ties.select("node", F.col("doc").alias("key"), "size"), goal)
        doc = _case(F.col("node"), {n: v for n, (v, _, _) in by_doc.items()}, "bigint")
        goal = {n: h - by_doc[n][1] for n, h in goal.items()}
        by_row = _medians(ties.where(F.col("doc") == doc).select("node", F.col("row").alias("key"), "size"), goal)
        # The median document itself goes to the side that it leaves closer to half.
        last = _case(F.col("node"), {n: v if goal[n] - before >= before + w - goal[n] else v - 1 for n, (v, before, w) in by_row.items()}, "bigint")
        own = F.coalesce("doc_id", F.lit(LEAST))
        right = (F.col("key") > here) | (F.col("key") == here) & ((own > doc) | (own == doc) & (F.col("row") > last))
        rows = keyed.withColumn("node", F.col("node") * 2 + F.when(right, 1).otherwise(0)).drop("key")
        if level % 2:
            rows = written(rows, "kd-level")
    return rows.withColumn("shard", (F.col("node") - shards).cast("int")).drop("node", "row")


def with_slots(rows: DataFrame) -> DataFrame:
    """Add slot: the row's place in its shard by doc_id, gapless from 0."""
    ranged = rows.repartitionByRange(F.col("shard"), F.col("doc_id")).sortWithinPartitions("shard", "doc_id")
    numbered = written(ranged.withColumn("row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(F.col("row"), 33).alias("part")
    # A row for each task and shard in it: the offsets are summed on the driver.
    seen, base = {}, []
    for r in sorted(numbered.groupBy(part, "shard").agg(F.min("row").alias("lo"), F.count("*").alias("n")).collect(), key=lambda r: (r.part, r.shard)):
        base.append((r.part, r.shard, seen.get(r.shard, 0) - r.lo))
        seen[r.shard] = seen.get(r.shard, 0) + r.n
    offsets = rows.sparkSession.createDataFrame(base, "part bigint, shard int, base bigint")
    return numbered.withColumn("part", part).join(offsets, ["part", "shard"]).withColumn("slot", F.col("row") + F.col("base")).drop("part", "row", "base")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(LEAST)).alias(c)
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), named("lang"), named("source"), F.coalesce(F.col("n_chars").cast("long"), F.lit(LEAST)).alias("n_chars"))
    sharded = with_slots(kd_tree(written(narrow.withColumn("row", F.monotonically_increasing_id()), "sizes")))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
