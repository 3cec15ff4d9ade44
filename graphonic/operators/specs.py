"""Lookups in specifications: readings by position, positions, ancestors, and words without the marks at their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spellings as s
from ..sources.inline import Inline, with_tables
from ..sources.readers import table
from .distances import _STEPS_SQL, _ancestor_steps

#: Graphemes and positions that a user may ask for; a null position asks for the plain readings.
ASKED = Inline("asked", "lang string, grapheme string, position string", (("en", "c", "before_front_vowel"), ("en", "c", "word_final"), ("en", "c", None), ("en", "e", "word_final"), ("de", "s", "word_initial"), ("de", "s", "nowhere"), ("en", "qqq", None), ("fr", "a", "word_initial")))
#: Pause punctuation of all scripts (fixed values).
PAUSES = (
    ".,;:!?…;⸮։׃،؛؞؟۔܀܁܂܃܄߸߹।॥"
    "၊။។៕᥄᥅᱾᱿꧇꧈꧉꩝꩞꩟꯫።፣፤፥፧"
    "᙮᠂᠃꓾꓿꘍꘎꘏、。！，．：；？｡､"
)
#: First and last mark of each range of other punctuation (fixed values).
PUNCTUATION = (("!", "/"), (":", "@"), ("[", "`"), ("{", "~"), ("¡", "¿"), ("‐", "‧"), ("‰", "⁞"), ("、", "〃"), ("！", "／"), ("：", "＠"), ("［", "｀"), ("｛", "･"))


def _edges() -> str:
    """A pattern of the marks that cling to a word's edges: all punctuation but for apostrophes."""
    marks = {ord(c) for c in PAUSES} | {k for a, b in PUNCTUATION for k in range(ord(a), ord(b) + 1)}
    some = "".join(f"\\x{{{k:x}}}" for k in sorted(marks - {ord("'"), ord("’")}))
    return f"^[{some}]+|[{some}]+$"


CLINGING = _edges()


def resolve_grapheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, grapheme, position, readings: those of the position, else the plain ones, else null."""
    at = s.POSITIONAL.df(spark).groupBy("lang", "grapheme", "position").agg(F.array_sort(F.collect_set("ipa")).alias("own"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "ipa")))
    plain = s.GRAPHEMES.df(spark).groupBy("lang", "grapheme").agg(F.transform(ordered, lambda x: x["ipa"]).alias("plain"))
    rows = F.broadcast(ASKED.df(spark))
    found = at.join(rows, ["lang", "grapheme", "position"], "right").join(plain, ["lang", "grapheme"], "left")
    return found.select("lang", "grapheme", "position", F.array_join(F.coalesce("own", "plain"), " ").alias("readings"))


def grapheme_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, grapheme, positions: where a grapheme has readings of its own, in order."""
    rows = s.POSITIONAL.df(spark).groupBy("lang", "grapheme").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return rows.select("lang", "grapheme", F.array_join("positions", " ").alias("positions"))


def ancestor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, ancestor, role, weight: the declared ancestors, or the parent at weight 1 where none is declared."""
    edges = s.EDGES.df(spark)
    parents = s.SPECS.df(spark).where("parent is not null").join(edges, "code", "left_anti")
    return edges.unionByName(parents.select("code", F.col("parent").alias("ancestor"), F.lit("parent").alias("role"), F.lit(1.0).alias("weight")))


def ancestry_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, place, ancestor: the parents above each spec, nearest first, clades and a missing last one included."""
    parents = s.SPECS.df(spark).where("parent is not null").select(F.col("code").alias("ancestor"), "parent")
    up = _ancestor_steps(spark).join(F.broadcast(parents), "ancestor").where("parent <> code")
    return up.groupBy("code", F.col("parent").alias("ancestor")).agg((F.min("depth") + 1).alias("place"))


def edge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, word: the blank-separated words of turns without the marks at their edges; none that are marks alone."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    rows = turns.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "raw"))
    return rows.select("conv_id", "turn", "pos", F.regexp_replace("raw", CLINGING, "").alias("word")).where("word <> ''")


QUERIES = {f.__name__: f for f in (resolve_grapheme, grapheme_positions, ancestor_links, ancestry_chain, edge_words)}
ORACLE_SQL = {
    "resolve_grapheme": f"{with_tables(ASKED, s.POSITIONAL, s.GRAPHEMES)} SELECT lang, grapheme, position, coalesce((SELECT string_agg(DISTINCT p.ipa, ' ' ORDER BY p.ipa) FROM positional_rows p WHERE p.lang = q.lang AND p.grapheme = q.grapheme AND p.position = q.position), (SELECT string_agg(g.ipa, ' ' ORDER BY g.rank) FROM graphemes g WHERE g.lang = q.lang AND g.grapheme = q.grapheme)) AS readings FROM asked q",
    "grapheme_positions": f"{with_tables(s.POSITIONAL)} SELECT lang, grapheme, string_agg(DISTINCT position, ' ' ORDER BY position) AS positions FROM positional_rows GROUP BY ALL",
    "ancestor_links": f"{with_tables(s.SPECS, s.EDGES)} SELECT * FROM edges UNION ALL SELECT code, parent, 'parent', CAST(1 AS DOUBLE) FROM specs WHERE parent IS NOT NULL AND code NOT IN (SELECT code FROM edges)",
    "ancestry_chain": f"{with_tables(s.SPECS)}, {_STEPS_SQL} SELECT st.code, k.parent AS ancestor, CAST(min(depth) + 1 AS INTEGER) AS place FROM st JOIN specs k ON k.code = st.ancestor WHERE k.parent IS NOT NULL AND k.parent <> st.code GROUP BY ALL",
    "edge_words": f"WITH r AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), e AS (SELECT conv_id, turn, unnest(ws) AS raw, generate_subscripts(ws, 1) AS k FROM r) SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS pos, regexp_replace(raw, '{CLINGING}', '', 'g') AS word FROM e WHERE regexp_replace(raw, '{CLINGING}', '', 'g') <> ''",
}
