"""Syllables, Arabic doubling, computed tone, spec checks and lects as queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic, tones
from ..functions import syllables as y
from ..sources import validation
from ..sources.inline import Inline, with_tables
from ..sources.readers import table
from .words import WORDS_SQL, distinct_words

_V = "[aeiouyáéíóúàèìòùâêîôûäëïöüãõæœø]"
_C = "[^aeiouyáéíóúàèìòùâêîôûäëïöüãõæœø|]"
ARABIC = Inline("arabic_words", "word string", (("مُدَرِّس",), ("شدّ",), ("حقَّ",), ("قُوَّة",), ("كتاب",), ("ّ",), ("",)))
#: Spellings and readings slot by slot for the synthetic tone system below.
SLOTS = Inline("tone_slots", "word string, graphemes array<string>, segments array<string>", (("ka", ("k", "a"), ("k", "a")), ("kat", ("k", "a", "t"), ("k", "a", "t")), ("kaam", ("k", "aa", "m"), ("k", "aː", "m")), ("h1an", ("h", "1", "a", "n"), ("h", "", "a", "n")), ("kahin", ("k", "a", "h", "i", "n"), ("k", "a", "h", "i", "n")), ("st", ("s", "t"), ("s", "t"))))
SYSTEM = tones.ToneSystem({"k": "mid", "h": "high"}, {"1": "one"}, {("mid", "live", "none"): "mid", ("mid", "any", "none"): "low", ("high", "live", "none"): "rising", ("high", "any", "one"): "low"}, {"mid": "˧", "low": "˨˩", "rising": "˩˩˦"}, ("p", "t", "k"))
#: A synthetic tree of lects, and regions of languages and of languages with a script.
LECTS = Inline("lects", "tag string, parent string", (("xa-x-north", "xa"), ("xa-x-south", "xa"), ("xa-x-coast", "xa-x-south"), ("xa-x-port", "xa-x-coast"), ("xb-x-hill", "xb")))
REGIONS = Inline("likely_regions", "tag string, region string", (("xa", "AA"), ("xb", "BB"), ("xb-Cyrl", "BC")))
LECT_TAGS = Inline("lect_tags", "tag string", tuple((t,) for t in ("xa", "xa-x-north", "xa-x-coast", "xa-x-port", "xb", "xb-x-hill", "xb-Cyrl", "xa-ZZ", "xc")))
SPECS = Inline("spec_files", "code string, text string", (("aa", '{"code": "aa", "name": "A", "script": "Latin", "clade": "yes", "allophone_passes": "2"}'), ("bb", '{"code": "bb", "extra": 1, "script": 3, "iso639_3": "BB1"}'), ("cc", '{"code": "cc", "name": "C", "script": "Latin", "location": {"latitude": 91, "longitude": "x"}, "quality": "great"}'), ("dd", "{")))


def word_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words cut before each vowel run with the one letter before it; what precedes the first joins it."""
    d = distinct_words(table(spark, sf_dir, "documents", "lang", "text")).select("lang", "word")
    cut = F.regexp_replace(F.regexp_replace("word", F.lit(f"({_C}?{_V}+)"), F.lit("|$1")), F.lit(r"^([^|]*)\|"), F.lit("$1"))
    return d.select("lang", "word", F.split(cut, r"\|").alias("syllables")).withColumn("n_syllables", F.size("syllables"))


def spoken_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of distinct words: their syllables, and the reading with iambic length."""
    from ..plans.transcribe import read_word

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [read_word(lang, w).ipa.replace(y.PRIMARY, "") for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([y.syllabify_ipa(x) for x in plain], pa.list_(pa.string())), pa.array([y.iambic_length(x) for x in plain], pa.string())], names=["lang", "word", "syllables", "lengthened"])

    return distinct_words(table(spark, sf_dir, "documents", "lang", "text")).select("lang", "word").mapInArrow(kernel, "lang string, word string, syllables array<string>, lengthened string")


def arabic_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with the doubling mark written twice: three replacements in order."""
    out = F.col("word")
    for pattern, groups in arabic.DOUBLED:
        out = F.regexp_replace(out, F.lit(pattern), F.lit("$1$1$2" if groups == 2 else "$1$1"))
    return ARABIC.df(spark).select("word", out.alias("doubled"))


def computed_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the tone that each syllable's spelling calls for."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [tones.with_tones(g, s, SYSTEM) for g, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, pa.string())], names=["word", "ipa"])

    return SLOTS.df(spark).mapInArrow(kernel, "word string, ipa string")


def spec_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of spec documents, one line each."""
    return validation.formatted(validation.validated(SPECS.df(spark)))


def _base(c: str):
    return F.regexp_replace(c, "-x-.*$", "")


def _ancestors(spark: SparkSession, name: str) -> DataFrame:
    """(tag, ancestor, depth): a lect, its declared parents, then the tag without private use.  The tree is a fixed small table."""
    up = F.broadcast(LECTS.df(spark).toDF("node", "up"))
    now = LECT_TAGS.df(spark).select(F.col("tag").alias(name), F.col("tag").alias("node"), F.lit(0).alias("depth"))
    out = now
    for _ in range(len(LECTS.rows)):
        next_ = F.coalesce("up", F.when(_base("node") != F.col("node"), _base("node")))
        now = now.join(up, "node", "left").select(name, next_.alias("node"), (F.col("depth") + 1).alias("depth")).where("node is not null")
        out = out.unionByName(now)
    return out


def lect_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between two lects over their nearest common ancestor; pairs without one have no row."""
    a, b = _ancestors(spark, "a"), _ancestors(spark, "b").withColumnRenamed("depth", "depth_b")
    return a.join(b, "node").groupBy("a", "b").agg(F.min(F.col("depth") + F.col("depth_b")).alias("steps"))


def lect_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 4 in the mode that prefers dialects: near by steps (3 at most), the standard last."""
    t = LECT_TAGS.df(spark)
    pairs = t.toDF("a").crossJoin(F.broadcast(t.toDF("b"))).join(lect_steps(spark, sf_dir), ["a", "b"], "left")
    own = lambda c: F.when(F.col(c).contains("-x-"), F.regexp_replace(c, "^.*?-x-", "")).otherwise("")
    near = F.least(F.coalesce("steps", F.lit(3)), F.lit(3))
    score = F.when(own("a") == own("b"), 0).when((own("a") != "") & (own("b") == ""), 4).when((own("b") != "") & (own("a") == ""), near + 1).otherwise(near)
    return pairs.select("a", "b", score.cast("int").alias("score"))


def default_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's own region, else that of its language with its script, else that of its language; none for lects."""
    part = lambda k: F.get(F.split("tag", "-"), k)
    t = LECT_TAGS.df(spark).withColumn("language", part(0)).withColumn("script", F.when(F.length(part(1)) == 4, part(1))).withColumn("own", F.when(F.length(part(1)) == 2, part(1)))
    known = REGIONS.df(spark)
    t = t.join(F.broadcast(known.toDF("scripted", "by_script")), F.concat_ws("-", "language", "script") == F.col("scripted"), "left")
    t = t.join(F.broadcast(known.toDF("plain", "by_language")), F.col("language") == F.col("plain"), "left")
    return t.select("tag", F.when(~F.col("tag").contains("-x-"), F.coalesce("own", F.when(F.col("script").isNotNull(), F.col("by_script")), "by_language")).alias("region"))


QUERIES = {f.__name__: f for f in (word_syllables, spoken_syllables, arabic_doubling, computed_tones, spec_errors, lect_steps, lect_score, default_region)}

_DOUBLED = "word"
for _p, _n in arabic.DOUBLED:
    _DOUBLED = f"regexp_replace({_DOUBLED}, '{_p}', '{r'\1\1\2' if _n == 2 else r'\1\1'}', 'g')"
_STEPS = f"{with_tables(LECTS, LECT_TAGS)}, up AS (SELECT tag, tag AS node, 0 AS depth FROM lect_tags UNION ALL SELECT up.tag, coalesce(l.parent, regexp_replace(up.node, '-x-.*$', '')), depth + 1 FROM up LEFT JOIN lects l ON l.tag = up.node WHERE (l.parent IS NOT NULL OR up.node LIKE '%-x-%') AND depth < 9), st AS (SELECT x.tag AS a, z.tag AS b, CAST(min(x.depth + z.depth) AS INTEGER) AS steps FROM up x JOIN up z USING (node) GROUP BY ALL)"
_OWN = "CASE WHEN {0} LIKE '%-x-%' THEN regexp_replace({0}, '^.*?-x-', '') ELSE '' END"
ORACLE_SQL = {
    "word_syllables": f"WITH {WORDS_SQL}, c AS (SELECT lang, word, string_split(regexp_replace(regexp_replace(word, '({_C}?{_V}+)', '|\\1', 'g'), '^([^|]*)\\|', '\\1'), '|') AS syllables FROM d) SELECT lang, word, syllables, CAST(len(syllables) AS INTEGER) AS n_syllables FROM c",
    "arabic_doubling": f"{with_tables(ARABIC)} SELECT word, {_DOUBLED} AS doubled FROM arabic_words",
    "lect_steps": f"{_STEPS} SELECT a, b, steps FROM st",
    "lect_score": f"{_STEPS}, p AS (SELECT x.tag AS a, z.tag AS b, least(coalesce(steps, 3), 3) AS near, {_OWN.format('x.tag')} AS oa, {_OWN.format('z.tag')} AS ob FROM lect_tags x CROSS JOIN lect_tags z LEFT JOIN st ON st.a = x.tag AND st.b = z.tag) SELECT a, b, CAST(CASE WHEN oa = ob THEN 0 WHEN oa <> '' AND ob = '' THEN 4 WHEN oa = '' THEN near + 1 ELSE near END AS INTEGER) AS score FROM p",
    "default_region": f"{with_tables(LECT_TAGS, REGIONS)}, p AS (SELECT tag, string_split(tag, '-') AS s FROM lect_tags) SELECT tag, CASE WHEN tag NOT LIKE '%-x-%' THEN coalesce(CASE WHEN len(s[2]) = 2 THEN s[2] END, CASE WHEN len(s[2]) = 4 THEN (SELECT region FROM likely_regions r WHERE r.tag = s[1] || '-' || s[2]) END, (SELECT region FROM likely_regions r WHERE r.tag = s[1])) END AS region FROM p",
}
