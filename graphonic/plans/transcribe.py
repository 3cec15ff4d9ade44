"""Transcription plans: text to pronunciations.

Documents are read in place: each worker keeps an engine a language and
remembers the words that it has read, so a word is computed about once a
worker, and no exploded word ever crosses a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import engine as e
from ..functions import utterance as u
from ..operators.words import distinct_word_table
from ..sources.readers import table

REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_ENGINES: dict[str, e.Engine | None] = {}
_READ: dict[tuple[str, str, int], e.Reading] = {}


def engine(lang: str | None) -> e.Engine | None:
    """A worker's engine of a language; None where the library has no spelling table."""
    if lang not in _ENGINES:
        from ..sources.spellings import LANGUAGES

        _ENGINES[lang] = e.own_engine(lang) if lang in LANGUAGES else None
    return _ENGINES[lang]


def read_word(lang: str, word: str, k: int = 1) -> e.Reading:
    """A word's k best readings, remembered; an unknown language reads a word as itself, with coverage 0."""
    found = _READ.get((lang, word, k))
    if found is None:
        if len(_READ) > REMEMBERED:
            _READ.clear()
        own = engine(lang)
        found = _READ[lang, word, k] = own.read(word, k) if own else e.Reading(word, word, 0.0, 0.0, (word,), word)
    return found


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            read = [read_word(lang, w) for w in _WORD.findall((text or "").lower())]
            n = len(read)
            rows.append({"doc_id": doc, "ipa": " ".join(r.ipa for r in read if r.ipa), "n_words": n, "coverage": sum(r.coverage for r in read) / n if n else 1.0, "confidence": min((r.confidence for r in read), default=1.0)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ipa", pa.string()), ("n_words", pa.int64()), ("coverage", pa.float64()), ("confidence", pa.float64())]))


def spread(df: DataFrame) -> DataFrame:
    """A small batch table read as fewer partitions than there are cores is dealt over the cores; others stay in place."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def transcribe(docs: DataFrame) -> DataFrame:
    """doc_id, ipa, n_words, coverage, confidence of each row; docs has doc_id, lang, text (batch or stream)."""
    return spread(docs.select("doc_id", "lang", "text")).mapInArrow(_documents, "doc_id bigint, ipa string, n_words bigint, coverage double, confidence double")


def candidates(words: DataFrame, k: int = 3) -> DataFrame:
    """(lang, word, rank, ipa) of the k best finalised readings of distinct words (lang, word)."""
    if k < 1:
        raise ValueError("k must be at least 1")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, w, i, ipa) for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, ipa in enumerate(read_word(lang, w, k).candidates, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["lang", "word", "rank", "ipa"])

    return words.select("lang", "word").mapInArrow(kernel, "lang string, word string, rank int, ipa string")


def transcribe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcribe(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))


def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(distinct_word_table(spark, sf_dir))


def _per_row(df: DataFrame, f, *columns: str) -> DataFrame:
    """The given columns and f of the last one, by Arrow batches."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([f(x) for x in batch.column(len(columns) - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(columns) - 1)] + [out], names=[*columns[:-1], "ipa"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns[:-1])
    return df.select(*columns).mapInArrow(kernel, f"{schema}, ipa string")


def _french(text: str | None) -> list[str]:
    return [r.ipa for w in _WORD.findall((text or "").lower()) if (r := read_word("fr", w)).ipa]


def sandhi_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as French words, with liaison and elision at their borders."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return _per_row(turns, lambda x: " ".join(u.sandhi(_french(x), u.LIAISON)), "conv_id", "turn", "text")


def dialect_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as Spanish, then shifted by a dialect profile."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return _per_row(turns, lambda x: u.dialect(" ".join(read_word("es", w).ipa for w in _WORD.findall((x or "").lower())), "chain"), "conv_id", "turn", "text")


def markup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose first word is given a reading by markup: the runs that the parser finds."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    marked = turns.withColumn("text", F.regexp_replace("text", r"^(\p{L}+)", '<phoneme alphabet="ipa" ph="ə">$1</phoneme>'))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    rows += [{"conv_id": conv, "turn": turn, "pos": k, "chunk": run, "forced": ipa, "error": None} for k, (run, ipa) in enumerate(u.parse_markup(text or ""))]
                except u.MarkupError as x:
                    rows.append({"conv_id": conv, "turn": turn, "pos": 0, "chunk": text, "forced": None, "error": str(x)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int32()), ("chunk", pa.string()), ("forced", pa.string()), ("error", pa.string())]))

    return marked.select("conv_id", "turn", "text").mapInArrow(kernel, "conv_id bigint, turn bigint, pos int, chunk string, forced string, error string")


QUERIES = {f.__name__: f for f in (transcribe_documents, word_candidates, sandhi_fold, dialect_transform, markup_chunks)}
ORACLE_SQL = {
    "markup_chunks": "WITH m AS (SELECT conv_id, turn, text, regexp_extract(text, '^\\p{L}+') AS w FROM conversations WHERE text <> '') SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, CASE WHEN w = '' THEN text ELSE w END AS chunk, CASE WHEN w <> '' THEN 'ə' END AS forced, CAST(NULL AS VARCHAR) AS error FROM m UNION ALL SELECT conv_id, turn, CAST(1 AS INTEGER), substr(text, length(w) + 1), NULL, NULL FROM m WHERE w <> '' AND length(text) > length(w)",
}
