"""N-gram counts, perplexity and edit-distance error rates.

Counts are of distinct words weighted by how often they occur, so a frequent
word is cut into n-grams once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table
from .words import WORDS_SQL, distinct_words, words


def ngrams(d: DataFrame, n: int) -> DataFrame:
    """(lang, ctx, next, n) of the letters of words (lang, word, n), bracketed by ^ and $."""
    padded = F.concat(F.lit("^" * (n - 1)), "word", F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("k")
    rows = d.select("lang", "n", padded.alias("w"), at)
    return rows.groupBy("lang", F.substring("w", F.col("k"), F.lit(n - 1)).alias("ctx"), F.substring("w", F.col("k") + n - 1, F.lit(1)).alias("next")).agg(F.sum("n").alias("n"))


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams(distinct_words(table(spark, sf_dir, "documents", "lang", "text")), 2)


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams(distinct_words(table(spark, sf_dir, "documents", "lang", "text")), 3)


def perplexity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one letter trigrams learnt from even documents, tested on odd ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    train, test = (ngrams(distinct_words(docs.where(F.col("doc_id") % 2 == k)), 3) for k in (0, 1))
    seen = train.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = test.join(train.withColumnRenamed("n", "c"), ["lang", "ctx", "next"], "left").join(seen, ["lang", "ctx"], "left")
    prob = (F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.coalesce("kinds", F.lit(0)) + 1)
    return rows.groupBy("lang").agg(F.round(F.pow(F.lit(2.0), -F.sum(F.col("n") * F.log2(prob)) / F.sum("n")), 6).alias("perplexity"))


def error_rate_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit edit distance of each benchmark word to the next one, over its letters."""
    bench = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("ws"))
    pairs = bench.select("item_id", "ws", F.posexplode("ws").alias("pos", "hyp")).withColumn("ref", F.get("ws", F.col("pos") + 1)).where("ref is not null")
    return pairs.select("item_id", "pos", "hyp", "ref", F.round(F.levenshtein("hyp", "ref") / F.length("ref"), 9).alias("per"))


def _sql(n: int, source: str = "d") -> str:
    return f"(SELECT lang, ctx, next, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, n, substr(w, k, {n - 1}) AS ctx, substr(w, k + {n - 1}, 1) AS next FROM (SELECT lang, n, '{'^' * (n - 1)}' || word || '$' AS w, unnest(range(1, length(word) + 2)) AS k FROM {source})) GROUP BY ALL)"


QUERIES = {f.__name__: f for f in (bigram_counts, trigram_counts, perplexity_by_lang, error_rate_unit)}
ORACLE_SQL = {
    "bigram_counts": f"WITH {WORDS_SQL} SELECT * FROM {_sql(2)}",
    "trigram_counts": f"WITH {WORDS_SQL} SELECT * FROM {_sql(3)}",
    "perplexity_by_lang": f"WITH {WORDS_SQL}, d0 AS (SELECT lang, word, count(*) AS n FROM w WHERE doc_id % 2 = 0 GROUP BY ALL), d1 AS (SELECT lang, word, count(*) AS n FROM w WHERE doc_id % 2 = 1 GROUP BY ALL), tr AS {_sql(3, 'd0')}, te AS {_sql(3, 'd1')}, se AS (SELECT lang, ctx, sum(n) AS total, count(*) AS kinds FROM tr GROUP BY ALL) SELECT te.lang, round(pow(2, -sum(te.n * log2((coalesce(tr.n, 0) + 1) / CAST(coalesce(total, 0) + coalesce(kinds, 0) + 1 AS DOUBLE))) / sum(te.n)), 6) AS perplexity FROM te LEFT JOIN tr USING (lang, ctx, next) LEFT JOIN se USING (lang, ctx) GROUP BY te.lang",
    "error_rate_unit": "WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), p AS (SELECT item_id, ws, unnest(ws) AS hyp, generate_subscripts(ws, 1) AS k FROM b) SELECT item_id, CAST(k - 1 AS INTEGER) AS pos, hyp, ws[k + 1] AS ref, round(levenshtein(hyp, ws[k + 1]) / CAST(length(ws[k + 1]) AS DOUBLE), 9) AS per FROM p WHERE k < len(ws)",
}
