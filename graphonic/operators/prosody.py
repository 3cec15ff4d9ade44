"""Tone and stress over small tables: priority lookups and positions from sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.inline import Inline, with_tables

#: A synthetic tone system: onset class, syllable shape ('any' matches all), written mark, tone.
TONES = Inline("tones", "class string, shape string, mark string, tone string", (("mid", "live", "", "˧"), ("mid", "any", "", "˨˩"), ("high", "live", "", "˩˩˦"), ("high", "any", "1", "˥˩"), ("low", "dead_long", "", "˥˩"), ("low", "dead_short", "", "˦˥"), ("low", "live", "", "˧")))
SYLLABLES = Inline("tone_syllables", "syllable string, class string, shape string, mark string", (("ma", "low", "live", ""), ("mak", "low", "dead_long", ""), ("mat", "low", "dead_short", ""), ("kha", "high", "live", ""), ("kha1", "high", "live", "1"), ("kat", "mid", "dead_short", ""), ("ka", "mid", "live", ""), ("ka2", "mid", "live", "2")))
STRESSED = Inline("stressed_words", "word string, n int, stressed int", (("a", 1, 0), ("b", 2, 1), ("c", 3, 2), ("d", 4, 3), ("e", 5, 3), ("f", 5, 4), ("g", 6, 2)))


def tone_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A syllable's tone by class, shape and mark; its own shape before 'any'; null if the table has neither."""
    t = TONES.df(spark)
    own = F.broadcast(t.select("class", "shape", "mark", F.col("tone").alias("own")))
    any_ = F.broadcast(t.where("shape = 'any'").select("class", "mark", F.col("tone").alias("other")))
    rows = SYLLABLES.df(spark).join(own, ["class", "shape", "mark"], "left").join(any_, ["class", "mark"], "left")
    return rows.select("syllable", F.coalesce("own", "other").alias("tone"))


def secondary_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating syllables from the parity of the stressed one to two before it; none in words of fewer than three."""
    at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (F.col("n") >= 3) & (k % 2 == F.col("stressed") % 2) & (k < F.col("stressed") - 1))
    return STRESSED.df(spark).select("word", F.array_join(F.transform(at, lambda k: k.cast("string")), " ").alias("secondary"))


QUERIES = {f.__name__: f for f in (tone_assign, secondary_stress)}
ORACLE_SQL = {
    "tone_assign": f"{with_tables(TONES, SYLLABLES)} SELECT syllable, coalesce((SELECT tone FROM tones t WHERE t.class = s.class AND t.shape = s.shape AND t.mark = s.mark), (SELECT tone FROM tones t WHERE t.class = s.class AND t.shape = 'any' AND t.mark = s.mark)) AS tone FROM tone_syllables s",
    "secondary_stress": f"{with_tables(STRESSED)} SELECT word, array_to_string(list_filter(range(0, n), lambda k: n >= 3 AND k % 2 = stressed % 2 AND k < stressed - 1), ' ') AS secondary FROM stressed_words",
}
