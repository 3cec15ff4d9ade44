"""From raw documents to training sequences: the stages, in order.

Each stage reads what its predecessor wrote, and writes Parquet for the next.

Defined results: a null or empty text has no words, is not toxic by its words,
is a near copy of other such texts only, holds no benchmark window and packs
as its end id; null metadata and extra columns (none named graphonic_row) pass
unread through all stages but the last; rows are judged one by one, also where
they share a doc_id or have none; of rows alike, that of the smallest doc_id
stays (null last), and of several such the first written; very long texts are
read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphonic.llm.common import ROW, numbered, table, written
from graphonic.llm.decontaminate import clean
from graphonic.llm.packing import pack
from graphonic.llm.simhash import similar
from graphonic.llm.toxicity import accepted, learned


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not take for toxic."""
    return accepted(docs, learned(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, the first of several, null last."""
    rows = numbered(docs, "rows")
    groups = similar(rows.select(F.col(ROW).alias("doc_id"), "text")).withColumnRenamed("doc_id", ROW)
    first = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    drop = groups.select(ROW).join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti")
    return rows.join(drop, ROW, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 ids."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A learned machine and components are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    now = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        now = written(stage(spark, now, sf_dir), f"stage-{name}")
    return now
