"""Streams: the word kernel has no state, so it runs on a stream as it is; counts keep state in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.words import words
from ..plans.transcribe import transcribe


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    """Parquet files of documents, read as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def transcribed(stream: DataFrame) -> DataFrame:
    """Pronunciations of each arriving document (append mode)."""
    return transcribe(stream)


def word_counts(stream: DataFrame) -> DataFrame:
    """Running counts of words by language (update or complete mode)."""
    return words(stream, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
