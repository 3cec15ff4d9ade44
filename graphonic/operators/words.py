"""Operators over words and graphemes: splitting, counting, tokenising, contexts, readings.

Words repeat, so what depends only on the word is computed on distinct
(lang, word) rows; neighbours inside a word are array positions of one row, so
contexts need no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import spellings as s
from ..sources.inline import with_tables
from ..sources.readers import table

WORDS_SQL = r"w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), d AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)"


def words(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each word of each text, in lower case."""
    return docs.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))


def distinct_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n): each word once, with its count (partial counts before the shuffle)."""
    return words(docs, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))


def graphemes(word: Column, lang: Column) -> Column:
    """Maximal munch by the language's longest-first alternation."""
    out = F.lit(None).cast("array<string>")
    for code in s.LANGUAGES:
        out = F.when(lang == code, F.regexp_extract_all(word, F.lit(s.alternation(code)), 1)).otherwise(out)
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


GRAPHEMES_SQL = "CASE " + " ".join(f"WHEN lang = '{c}' THEN regexp_extract_all(word, {_quoted(s.alternation(c))}, 1)" for c in s.LANGUAGES) + " END"
SPLIT_SQL = f"{WORDS_SQL}, g AS (SELECT lang, word, {GRAPHEMES_SQL} AS gs FROM d), t AS (SELECT lang, word, unnest(gs) AS grapheme, generate_subscripts(gs, 1) - 1 AS pos FROM g)"


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, word, gs): the graphemes of each distinct word."""
    return distinct_words(table(spark, sf_dir, "documents", "lang", "text")).select("lang", "word", graphemes(F.col("word"), F.col("lang")).alias("gs"))


def readings_map(lang: Column, value) -> Column:
    """Grapheme to value(readings) as a map literal for each language."""
    out = None
    for code in s.LANGUAGES:
        pairs = [F.lit(x) for g, v in sorted(s.spelling(code).items()) for x in (g, value(v))]
        out = F.when(lang == code, F.create_map(*pairs)) if out is None else out.when(lang == code, F.create_map(*pairs))
    return out


def word_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinct_words(table(spark, sf_dir, "documents", "lang", "text"))
    return d.groupBy("lang").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def top_words_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinct_words(table(spark, sf_dir, "documents", "lang", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return d.withColumn("rank", rank).where("rank <= 20")


def distinct_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(table(spark, sf_dir, "documents", "lang", "text"))


_KINDS = {"letters": r"\p{L}", "digits": r"\p{Nd}", "spaces": r"[ \n\t]", "punctuation": r"[\p{P}\p{S}]"}


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in _KINDS.items()])


def grapheme_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("lang", "word", F.posexplode("gs").alias("pos", "grapheme"))


def grapheme_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("lang", F.explode("gs").alias("grapheme")).groupBy("lang", "grapheme").agg(F.count("*").alias("n"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = split(spark, sf_dir).select("lang", "word", "gs", F.posexplode("gs").alias("pos", "grapheme"))
    at = lambda k: F.get("gs", F.col("pos") + k)
    return g.select("lang", "word", "pos", "grapheme", at(-2).alias("prev2"), at(-1).alias("prev"), at(1).alias("next"), at(2).alias("next2"))


def crf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = split(spark, sf_dir).withColumn("counts", readings_map(F.col("lang"), len))
    g = g.select("lang", "word", "gs", "counts", F.posexplode("gs").alias("pos", "grapheme"))
    n = F.coalesce(F.try_element_at("counts", F.col("grapheme")), F.lit(0))
    return g.select("lang", "word", "pos", "grapheme", F.get("gs", F.col("pos") - 1).alias("prev"), F.get("gs", F.col("pos") + 1).alias("next"), (F.col("pos") == 0).alias("word_initial"), (F.col("pos") == F.size("gs") - 1).alias("word_final"), F.col("grapheme").rlike("^[aeiouyáéíóúàèìòùâêîôûäëïöü]").alias("is_vowel"), n.alias("n_candidates"), F.when(n > 1, 1.0).alias("margin"))


def g2p_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = split(spark, sf_dir).withColumn("best", readings_map(F.col("lang"), lambda v: v[0]))
    return g.select("lang", "word", F.array_join(F.transform("gs", lambda x: F.coalesce(F.try_element_at("best", x), x)), "").alias("ipa"))


def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = split(spark, sf_dir).withColumn("counts", readings_map(F.col("lang"), len))
    slot = lambda x: F.when(F.try_element_at("counts", x) > 1, 1 - F.exp(F.lit(-1.0))).when(F.try_element_at("counts", x) == 1, 1.0)
    return g.select("lang", "word", F.round(F.coalesce(F.array_min(F.transform("gs", slot)), F.lit(1.0)), 9).alias("confidence"))


def coverage_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    letters, digits = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"\p{Nd}"))
    known = F.regexp_count(F.lower("text"), F.lit("[a-zßäçèéêíñóöü]"))
    return docs.select("doc_id", (letters + digits).cast("long").alias("total"), (letters + digits - known).cast("long").alias("missing"), F.round(F.when(letters + digits == 0, 1.0).otherwise(known / (letters + digits)), 9).alias("coverage"))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words between pauses, as islands: a run ends at a word that pause punctuation follows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    runs = F.filter(F.split("text", r"[.,;:!?\n]+"), lambda x: x.rlike(r"\p{L}"))
    return docs.select("doc_id", F.posexplode(runs).alias("run", "piece")).select("doc_id", "run", F.regexp_count("piece", F.lit(r"\p{L}+")).cast("long").alias("n_words"))


def phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of each utterance with its place in its phrase: initial, medial, final or sole."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    phrases = turns.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"[.,;:!?\n]+"), lambda x: x.rlike(r"\p{L}"))).alias("phrase", "piece"))
    w = phrases.select("conv_id", "turn", "phrase", F.regexp_extract_all(F.lower("piece"), F.lit(r"(\p{L}+)"), 1).alias("ws")).select("conv_id", "turn", "phrase", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "word"))
    place = F.when(F.col("n") == 1, "sole").when(F.col("pos") == 0, "initial").when(F.col("pos") == F.col("n") - 1, "final").otherwise("medial")
    return w.select("conv_id", "turn", "phrase", "pos", "word", place.alias("position"))


def lexicon_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = s.LEXICON.df(spark).groupBy("lang", "word").agg(F.min_by("ipa", "priority").alias("forced"))
    g = g2p_greedy(spark, sf_dir).join(F.broadcast(best), ["lang", "word"], "left")
    return g.select("lang", "word", F.coalesce("forced", "ipa").alias("ipa"), F.col("forced").isNotNull().alias("from_lexicon"))


def lexicon_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import lexicon_of_lines

    return lexicon_of_lines(s.LEXICON_LINES.df(spark))


def ending_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinct_word_table(spark, sf_dir).select("lang", "word")
    e = F.broadcast(s.ENDINGS.df(spark))
    hit = d.join(e, (d.lang == e.lang) & d.word.endswith(e.ending) & (F.length(d.word) > F.length(e.ending)))
    return hit.groupBy(d.lang, d.word).agg(F.max_by(F.struct("ending", "ipa"), F.length("ending")).alias("top")).select("lang", "word", F.col("top.ending").alias("ending"), F.col("top.ipa").alias("ipa"))


_VOWEL = "[aeiouyáéíóúàèìòùâêîôûäëïöü]"


def _position_hits(g: DataFrame) -> DataFrame:
    prev, next_ = F.get("gs", F.col("pos") - 1), F.get("gs", F.col("pos") + 1)
    keys = F.array_compact(F.array(F.when(next_.rlike("^[eiéèêíäöü]"), "before_front_vowel"), F.when(F.col("pos") == 0, "word_initial"), F.when(F.col("pos") == F.size("gs") - 1, "word_final"), F.when(prev.rlike(f"{_VOWEL}$") & next_.rlike(f"^{_VOWEL}"), "intervocalic")))
    return g.select("lang", "word", "pos", "grapheme", F.explode(keys).alias("position"))


def positional_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of the first declared position of each grapheme that has one."""
    g = split(spark, sf_dir).select("lang", "word", "gs", F.posexplode("gs").alias("pos", "grapheme"))
    own = F.broadcast(s.POSITIONAL.df(spark).join(s.POSITION_ORDER.df(spark), "position"))
    hits = _position_hits(g).join(own, ["lang", "grapheme", "position"])
    return hits.groupBy("lang", "word", "pos", "grapheme").agg(F.min_by(F.struct("position", "ipa"), "place").alias("top")).select("lang", "word", "pos", "grapheme", F.col("top.position").alias("position"), F.col("top.ipa").alias("ipa"))


def allophone_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule, in order, that fits a reading and its neighbours."""
    g = split(spark, sf_dir).withColumn("best", readings_map(F.col("lang"), lambda v: v[0]))
    g = g.select("lang", "word", F.transform("gs", lambda x: F.coalesce(F.try_element_at("best", x), x)).alias("gs")).select("lang", "word", "gs", F.posexplode("gs").alias("pos", "phoneme"))
    vowel = lambda c: F.when(c.rlike("^[aeiouyæɑɒɐɔəɛɪʊʌøœʏ]"), "vowel").when(c.isNotNull(), "consonant")
    g = g.select("lang", "word", "pos", "phoneme", vowel(F.get("gs", F.col("pos") - 1)).alias("left_class"), vowel(F.get("gs", F.col("pos") + 1)).alias("right_class"), (F.col("pos") == 0).alias("first"), (F.col("pos") == F.size("gs") - 1).alias("last"))
    r = F.broadcast(s.ALLOPHONE_RULES.df(spark))
    fits = (F.col("word_initial").isNull() | (F.col("word_initial") == F.col("first"))) & (F.col("word_final").isNull() | (F.col("word_final") == F.col("last"))) & (F.col("after").isNull() | (F.col("after") == F.col("left_class"))) & (F.col("before").isNull() | (F.col("before") == F.col("right_class")))
    return g.join(r, ["lang", "phoneme"]).where(fits).groupBy("lang", "word", "pos", "phoneme").agg(F.min_by(F.struct("rule", "surface"), "place").alias("top")).select("lang", "word", "pos", "phoneme", F.col("top.rule").alias("rule"), F.col("top.surface").alias("surface"))


def geminate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinct_word_table(spark, sf_dir)
    return d.select("lang", "word", F.regexp_replace("word", r"([^aeiouyáéíóúàèìòùâêîôûäëïöü])\1+", "$1").alias("collapsed"))


def stress_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distinct_word_table(spark, sf_dir).withColumn("n_syllables", F.regexp_count("word", F.lit(f"{_VOWEL}+")))
    at = F.when(F.col("lang") == "fr", F.col("n_syllables") - 1).when(F.col("lang") == "de", 0).otherwise(F.col("n_syllables") - 2)
    return d.select("lang", "word", "n_syllables", F.greatest(at, F.lit(0)).alias("stressed"))


_V = "'^[aeiouyáéíóúàèìòùâêîôûäëïöü]'"
_READ = "(SELECT lang, grapheme, ipa FROM graphemes WHERE rank = 0)"
_SPLIT_LANG = f"{with_tables(s.GRAPHEMES)}, {SPLIT_SQL}"
_GREEDY = f"{_SPLIT_LANG}, greedy AS (SELECT t.lang, t.word, string_agg(coalesce(r.ipa, t.grapheme), '' ORDER BY pos) AS ipa FROM t LEFT JOIN {_READ} r USING (lang, grapheme) GROUP BY ALL)"
_COUNTS = "(SELECT lang, grapheme, count(*) AS c FROM graphemes GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (word_counts_by_lang, top_words_per_lang, token_kinds, grapheme_tokens, grapheme_freq, neighbour_context, crf_features, g2p_greedy, word_confidence, coverage_by_doc, word_runs, phrase_positions, lexicon_override, lexicon_first_wins, ending_longest_match, positional_pick, allophone_first_rule, geminate_collapse, stress_default)} | {"distinct_words": distinct_word_table}

ORACLE_SQL = {
    "word_counts_by_lang": f"WITH {WORDS_SQL} SELECT lang, CAST(sum(n) AS BIGINT) AS words, count(*) AS distinct_words FROM d GROUP BY lang",
    "top_words_per_lang": f"WITH {WORDS_SQL} SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM d QUALIFY rank <= 20",
    "distinct_words": f"WITH {WORDS_SQL} SELECT lang, word, n FROM d",
    "token_kinds": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _KINDS.items()) + " FROM documents",
    "grapheme_tokens": f"WITH {SPLIT_SQL} SELECT lang, word, CAST(pos AS INTEGER) AS pos, grapheme FROM t",
    "grapheme_freq": f"WITH {SPLIT_SQL} SELECT lang, grapheme, count(*) AS n FROM t GROUP BY ALL",
    "neighbour_context": f"WITH {SPLIT_SQL} SELECT lang, word, CAST(pos AS INTEGER) AS pos, grapheme, lag(grapheme, 2) OVER o AS prev2, lag(grapheme) OVER o AS prev, lead(grapheme) OVER o AS next, lead(grapheme, 2) OVER o AS next2 FROM t WINDOW o AS (PARTITION BY lang, word ORDER BY pos)",
    "crf_features": f"{_SPLIT_LANG} SELECT t.lang, word, CAST(pos AS INTEGER) AS pos, t.grapheme, lag(t.grapheme) OVER o AS prev, lead(t.grapheme) OVER o AS next, pos = 0 AS word_initial, lead(t.grapheme) OVER o IS NULL AS word_final, regexp_matches(t.grapheme, {_V}) AS is_vowel, CAST(coalesce(c, 0) AS INTEGER) AS n_candidates, CASE WHEN c > 1 THEN CAST(1 AS DOUBLE) END AS margin FROM t LEFT JOIN {_COUNTS} c ON c.lang = t.lang AND c.grapheme = t.grapheme WINDOW o AS (PARTITION BY t.lang, word ORDER BY pos)",
    "g2p_greedy": f"{_GREEDY} SELECT lang, word, ipa FROM greedy",
    "word_confidence": f"{_SPLIT_LANG} SELECT t.lang, word, round(coalesce(min(CASE WHEN c > 1 THEN 1 - exp(CAST(-1 AS DOUBLE)) WHEN c = 1 THEN CAST(1 AS DOUBLE) END), 1.0), 9) AS confidence FROM t LEFT JOIN {_COUNTS} c ON c.lang = t.lang AND c.grapheme = t.grapheme GROUP BY ALL",
    "coverage_by_doc": r"WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) + len(regexp_extract_all(text, '\p{Nd}')) AS total, len(regexp_extract_all(lower(text), '[a-zßäçèéêíñóöü]')) AS known FROM documents) SELECT doc_id, total, total - known AS missing, round(CASE WHEN total = 0 THEN CAST(1 AS DOUBLE) ELSE known / CAST(total AS DOUBLE) END, 9) AS coverage FROM a",
    "word_runs": r"WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '[.,;:!?\n]+'), lambda x: regexp_matches(x, '\p{L}')) AS r FROM documents), q AS (SELECT doc_id, unnest(r) AS piece, generate_subscripts(r, 1) - 1 AS run FROM p) SELECT doc_id, CAST(run AS INTEGER) AS run, len(regexp_extract_all(piece, '\p{L}+')) AS n_words FROM q",
    "phrase_positions": r"WITH p AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[.,;:!?\n]+'), lambda x: regexp_matches(x, '\p{L}')) AS r FROM conversations), q AS (SELECT conv_id, turn, unnest(r) AS piece, generate_subscripts(r, 1) - 1 AS phrase FROM p), v AS (SELECT conv_id, turn, phrase, regexp_extract_all(lower(piece), '\p{L}+') AS ws FROM q), x AS (SELECT conv_id, turn, phrase, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM v) SELECT conv_id, turn, CAST(phrase AS INTEGER) AS phrase, CAST(pos AS INTEGER) AS pos, word, CASE WHEN n = 1 THEN 'sole' WHEN pos = 0 THEN 'initial' WHEN pos = n - 1 THEN 'final' ELSE 'medial' END AS position FROM x",
    "lexicon_override": f"{_GREEDY.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + s.LEXICON.sql() + ', ', 1)}, b AS (SELECT lang, word, arg_min(ipa, priority) AS forced FROM lexicon GROUP BY ALL) SELECT lang, word, coalesce(forced, ipa) AS ipa, forced IS NOT NULL AS from_lexicon FROM greedy LEFT JOIN b USING (lang, word)",
    "lexicon_first_wins": f"{with_tables(s.LEXICON_LINES)}, p AS (SELECT line, string_split(text, chr(9)) AS f FROM lexicon_lines) SELECT f[1] AS word, arg_min(f[2], line) AS ipa, CAST(min(line) AS INTEGER) AS line FROM p WHERE len(f) = 2 AND f[1] <> '' AND f[2] <> '' GROUP BY 1",
    "ending_longest_match": f"{with_tables(s.ENDINGS)}, {WORDS_SQL} SELECT d.lang, word, arg_max(ending, length(ending)) AS ending, arg_max(ipa, length(ending)) AS ipa FROM d JOIN endings e ON d.lang = e.lang AND suffix(word, ending) AND length(word) > length(ending) GROUP BY ALL",
    "positional_pick": f"{with_tables(s.POSITIONAL, s.POSITION_ORDER)}, {SPLIT_SQL}, c AS (SELECT *, lag(grapheme) OVER o AS prev, lead(grapheme) OVER o AS next FROM t WINDOW o AS (PARTITION BY lang, word ORDER BY pos)), k AS (SELECT lang, word, pos, grapheme, unnest([CASE WHEN regexp_matches(next, '^[eiéèêíäöü]') THEN 'before_front_vowel' END, CASE WHEN prev IS NULL THEN 'word_initial' END, CASE WHEN next IS NULL THEN 'word_final' END, CASE WHEN regexp_matches(prev, '[aeiouyáéíóúàèìòùâêîôûäëïöü]$') AND regexp_matches(next, {_V}) THEN 'intervocalic' END]) AS position FROM c) SELECT lang, word, CAST(pos AS INTEGER) AS pos, grapheme, arg_min(position, place) AS position, arg_min(ipa, place) AS ipa FROM k JOIN positional_rows USING (lang, grapheme, position) JOIN position_order USING (position) GROUP BY ALL",
    "allophone_first_rule": f"{with_tables(s.GRAPHEMES, s.ALLOPHONE_RULES)}, {SPLIT_SQL}, a AS (SELECT t.lang, word, pos, coalesce(r.ipa, t.grapheme) AS phoneme FROM t LEFT JOIN {_READ} r USING (lang, grapheme)), c AS (SELECT *, lag(phoneme) OVER o AS prev, lead(phoneme) OVER o AS next FROM a WINDOW o AS (PARTITION BY lang, word ORDER BY pos)), k AS (SELECT *, CASE WHEN regexp_matches(prev, '^[aeiouyæɑɒɐɔəɛɪʊʌøœʏ]') THEN 'vowel' WHEN prev IS NOT NULL THEN 'consonant' END AS lc, CASE WHEN regexp_matches(next, '^[aeiouyæɑɒɐɔəɛɪʊʌøœʏ]') THEN 'vowel' WHEN next IS NOT NULL THEN 'consonant' END AS rc FROM c) SELECT lang, word, CAST(pos AS INTEGER) AS pos, phoneme, arg_min(rule, place) AS rule, arg_min(surface, place) AS surface FROM k JOIN allophone_rules USING (lang, phoneme) WHERE (word_initial IS NULL OR word_initial = (prev IS NULL)) AND (word_final IS NULL OR word_final = (next IS NULL)) AND (after IS NULL OR after = lc) AND (before IS NULL OR before = rc) GROUP BY ALL",
    "geminate_collapse": f"WITH {WORDS_SQL}, c AS (SELECT lang, word, string_split(word, '') AS cs FROM d) SELECT lang, word, array_to_string(list_filter(cs, lambda x, i: i = 1 OR x <> cs[i - 1] OR regexp_matches(x, {_V})), '') AS collapsed FROM c",
    "stress_default": f"WITH {WORDS_SQL}, c AS (SELECT lang, word, CAST(len(regexp_extract_all(word, '[aeiouyáéíóúàèìòùâêîôûäëïöü]+')) AS INTEGER) AS n_syllables FROM d) SELECT lang, word, n_syllables, CAST(greatest(CASE lang WHEN 'fr' THEN n_syllables - 1 WHEN 'de' THEN 0 ELSE n_syllables - 2 END, 0) AS INTEGER) AS stressed FROM c",
}
