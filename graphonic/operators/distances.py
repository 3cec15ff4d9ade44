"""Inventories, distances, ancestry, tags: set algebra over specification tables.

These tables have a row a language or a phone, so pairs of languages are a
self-join on a constant-size dimension; distances between phones are computed
once for each pair of phones and joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phones as p
from ..sources import spellings as s
from ..sources.inline import Inline, with_tables

_USED = sorted({ipa for r in s.SPEC_GRAPHEMES.rows if (ipa := r[3])} | {r[3] for r in s.POSITIONAL.rows if r[3]} | set("iouydɡkvzʒθðxlrnŋøœɑʊ"))
PHONES = Inline("phones", "phone string, known boolean, vowel boolean, features array<double>", tuple((x, p.vector(x) is not None, p.is_vowel(x), tuple(p.feature_vector(x))) for x in _USED))
WEIGHTS = Inline("feature_weights", "place int, weight double, of_vowels boolean, of_consonants boolean", tuple((k, w, k in p.VOWEL_FEATURES, k in p.CONSONANT_FEATURES) for k, w in enumerate(p.WEIGHTS)))
TYPES = Inline("type_distance", "a string, b string, d double", tuple((x, y, d) for a, row in {
    # Distances between types of script (fixed values).
    "alphabet": {"abjad": 0.3, "abugida": 0.4, "syllabary": 0.5, "featural": 0.3, "logographic": 0.9, "mixed": 0.7, "reconstruction": 0.1},
    "abjad": {"abugida": 0.4, "syllabary": 0.6, "featural": 0.5, "logographic": 0.9, "mixed": 0.7, "reconstruction": 0.3},
    "abugida": {"syllabary": 0.4, "featural": 0.5, "logographic": 0.8, "mixed": 0.6, "reconstruction": 0.3},
    "syllabary": {"featural": 0.5, "logographic": 0.7, "mixed": 0.4, "reconstruction": 0.5},
    "logographic": {"featural": 0.8, "mixed": 0.3, "reconstruction": 0.8},
    "featural": {"mixed": 0.6, "reconstruction": 0.3},
    "mixed": {"reconstruction": 0.6},
}.items() for b, d in row.items() for x, y in ((a, b), (b, a))))
SYLLABLE_WEIGHTS = Inline("syllable_weights", "word string, weights array<string>", (("a", ("light",)), ("b", ("light", "superheavy")), ("c", ("light", "heavy", "light")), ("d", ("heavy", "light", "light")), ("e", ("light", "light")), ("f", ("light", "light", "light", "heavy"))))
RADIUS = 6371.0088


def _ancestor_steps(spark: SparkSession) -> DataFrame:
    """(code, ancestor, depth) of every spec over its parents, itself at 0; only parents that exist, each once."""
    return spark.sql(f"WITH RECURSIVE {_STEPS_SQL.replace('list_contains', 'array_contains').replace('[code]', 'array(code)').replace('list_append', 'array_append')} SELECT code, ancestor, depth FROM st".replace("specs", "{specs}"), specs=s.SPECS.df(spark))


_STEPS_SQL = "st AS (SELECT code, code AS ancestor, 0 AS depth, [code] AS path FROM specs UNION ALL SELECT st.code, k.code, depth + 1, list_append(path, k.code) FROM st JOIN specs c ON c.code = st.ancestor JOIN specs k ON k.code = c.parent WHERE NOT list_contains(path, k.code))"


def resolved_graphemes(spark: SparkSession) -> DataFrame:
    """Own entries over inherited ones, key by key and whole; an entry without a reading deletes what it covers."""
    steps = _ancestor_steps(spark).join(s.SPEC_GRAPHEMES.df(spark).withColumnRenamed("code", "ancestor"), "ancestor")
    near = steps.groupBy("code", "grapheme").agg(F.min("depth").alias("depth"))
    return steps.join(near, ["code", "grapheme", "depth"]).where("ipa is not null").select("code", "grapheme", "rank", "ipa")


_RESOLVED_SQL = f"{_STEPS_SQL}, ra AS (SELECT st.code, depth, grapheme, rank, ipa FROM st JOIN spec_graphemes g ON g.code = st.ancestor), rg AS (SELECT ra.code, ra.grapheme, rank, ipa FROM ra JOIN (SELECT code, grapheme, min(depth) AS depth FROM ra GROUP BY ALL) m ON ra.code = m.code AND ra.grapheme = m.grapheme AND ra.depth = m.depth WHERE ipa IS NOT NULL), inv AS (SELECT DISTINCT code, ipa FROM rg)"


def _inventories(spark: SparkSession) -> DataFrame:
    return resolved_graphemes(spark).groupBy("code").agg(F.collect_set("ipa").alias("phones"))


def _pairs(rows: DataFrame, key: str = "code") -> DataFrame:
    """Unordered pairs of the rows of a dimension: a.key < b.key."""
    a = rows.select(*[F.col(c).alias(f"{c}_a") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
    return a.join(F.broadcast(b), F.col(f"{key}_a") < F.col(f"{key}_b"))


def _jaccard(a: str, b: str, empty: float):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def spec_graphemes_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_graphemes(spark)


def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = s.SPECS.df(spark)
    return specs.where("parent is not null").join(specs.select(F.col("code").alias("parent")), "parent", "left_anti").select("code", "parent")


def emission_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a language can emit: the union of its sources, without the empty reading."""
    parts = [s.GRAPHEMES.df(spark).select("lang", "ipa"), s.POSITIONAL.df(spark).select("lang", "ipa"), s.ENDINGS.df(spark).select("lang", "ipa"), s.LEXICON.df(spark).select("lang", "ipa"), s.ALLOPHONE_RULES.df(spark).select("lang", F.col("surface").alias("ipa"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where("ipa <> ''").distinct()


def phoneme_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(_inventories(spark))
    return pairs.select("code_a", "code_b", F.size(F.array_intersect("phones_a", "phones_b")).alias("shared"), F.round(1 - _jaccard("phones_a", "phones_b", 1.0), 9).alias("jaccard_distance"))


def phoneme_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = _inventories(spark)
    a, b = inv.toDF("native", "x"), inv.toDF("target", "y")
    return a.join(F.broadcast(b), F.col("native") != F.col("target")).select("native", "target", F.round(F.size(F.array_intersect("x", "y")) / F.size("y"), 9).alias("coverage"))


def _phone_pairs(spark: SparkSession) -> DataFrame:
    """(a, b, d): the distance of each ordered pair of phones, computed once."""
    ph = PHONES.df(spark)
    w = F.array(*[F.lit(x) for x in p.WEIGHTS])
    mask = lambda chosen: F.array(*[F.lit(float(k in chosen)) for k in range(len(p.FEATURES))])
    a, b = ph.toDF("a", "ka", "va", "fa"), ph.toDF("b", "kb", "vb", "fb")
    kind = F.when(F.col("va"), mask(p.VOWEL_FEATURES)).otherwise(mask(p.CONSONANT_FEATURES))
    add = lambda acc, x: acc + x
    differ = F.zip_with(F.zip_with("fa", "fb", lambda x, y: (x != y).cast("double")), F.zip_with(w, kind, lambda x, y: x * y), lambda x, y: x * y)
    total = F.aggregate(F.zip_with(w, kind, lambda x, y: x * y), F.lit(0.0), add)
    d = F.when(F.col("a") == F.col("b"), 0.0).when((F.col("va") != F.col("vb")) | ~F.col("ka") | ~F.col("kb"), 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(differ, F.lit(0.0), add) / total * F.when(F.col("va"), 1.0).otherwise(2.0)))
    return a.crossJoin(F.broadcast(b)).select("a", "b", d.alias("d"))


_PHONE_SQL = "fp AS (SELECT phone, known, vowel, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS place FROM phones), pp AS (SELECT a.phone AS a, b.phone AS b, CASE WHEN a.phone = b.phone THEN CAST(0 AS DOUBLE) WHEN any_value(a.vowel) <> any_value(b.vowel) OR NOT any_value(a.known) OR NOT any_value(b.known) THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), sum(CASE WHEN a.x <> b.x AND (CASE WHEN a.vowel THEN of_vowels ELSE of_consonants END) THEN weight ELSE 0 END) / sum(CASE WHEN (CASE WHEN a.vowel THEN of_vowels ELSE of_consonants END) THEN weight ELSE 0 END) * CASE WHEN any_value(a.vowel) THEN 1 ELSE 2 END) END AS d FROM fp a JOIN fp b USING (place) JOIN feature_weights USING (place) GROUP BY a.phone, b.phone)"


def segment_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phone_pairs(spark).select("a", "b", F.round("d", 9).alias("distance"))


def _mean_min(spark: SparkSession) -> DataFrame:
    """(code_a, code_b, d) over ordered pairs: the mean over a's phones of the distance to b's nearest."""
    inv = resolved_graphemes(spark).select("code", "ipa").distinct()
    a, b = inv.toDF("code_a", "a"), inv.toDF("code_b", "b")
    near = a.join(F.broadcast(_phone_pairs(spark)), "a").join(F.broadcast(b), "b").where("code_a <> code_b").groupBy("code_a", "code_b", "a").agg(F.min("d").alias("d"))
    return near.groupBy("code_a", "code_b").agg(F.avg("d").alias("d"))


def inventory_mean_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mean_min(spark)
    back = m.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), F.col("d").alias("e"))
    return m.where("code_a < code_b").join(back, ["code_a", "code_b"]).select("code_a", "code_b", F.round((F.col("d") + F.col("e")) / 2, 9).alias("feature_mean"))


def _divergence(spark: SparkSession) -> DataFrame:
    """code_a, code_b, shared, divergence: over shared graphemes the mean distance of each reading to the nearest of the other side.

    A silent reading is looked for by none and 1 away from any; a grapheme
    without another reading counts 1.
    """
    g = resolved_graphemes(spark).select("code", F.lower("grapheme").alias("grapheme"), "ipa")
    a, b = g.toDF("code_a", "grapheme", "a"), g.toDF("code_b", "grapheme", "b")
    both = a.join(b, "grapheme").where("code_a < code_b").join(F.broadcast(_phone_pairs(spark)), ["a", "b"], "left").withColumn("d", F.coalesce("d", F.lit(1.0)))
    keys = ["code_a", "code_b", "grapheme"]
    one = lambda x: both.groupBy(*keys, x).agg(F.min("d").alias("d")).select(*keys, F.when(F.col(x) != "", F.col("d")).alias("d"))
    per = one("a").unionAll(one("b")).groupBy(*keys).agg(F.coalesce(F.avg("d"), F.lit(1.0)).alias("d"))
    return per.groupBy("code_a", "code_b").agg(F.count("*").alias("shared"), F.avg("d").alias("divergence"))


def grapheme_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark).select("code_a", "code_b", "shared", F.round("divergence", 9).alias("divergence"))


def spelling_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over shared phonemes: one less the Jaccard overlap of their spellings."""
    g = resolved_graphemes(spark).groupBy("code", "ipa").agg(F.collect_set(F.lower("grapheme")).alias("gs"))
    both = g.toDF("code_a", "ipa", "x").join(g.toDF("code_b", "ipa", "y"), "ipa").where("code_a < code_b")
    return both.groupBy("code_a", "code_b").agg(F.count("*").alias("shared"), F.round(F.avg(1 - _jaccard("x", "y", 1.0)), 9).alias("divergence"))


def allophone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = s.SPEC_ALLOPHONES.df(spark).where("surface not in ('', '∅')").groupBy("code").agg(F.collect_set("surface").alias("xs"))
    all_ = s.SPECS.df(spark).where("not clade").select("code").join(real, "code", "left").select("code", F.coalesce("xs", F.array().cast("array<string>")).alias("xs"))
    return _pairs(all_).select("code_a", "code_b", F.round(_jaccard("xs_a", "xs_b", 1.0), 9).alias("overlap"))


def tone_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.SPEC_TONES.df(spark).groupBy("code").agg(F.collect_set("tone").alias("xs"))
    all_ = s.SPECS.df(spark).where("not clade").select("code").join(t, "code", "left").select("code", F.coalesce("xs", F.array().cast("array<string>")).alias("xs"))
    return _pairs(all_).select("code_a", "code_b", F.round(1 - _jaccard("xs_a", "xs_b", 1.0), 9).alias("distance"))


def _scripts(spark: SparkSession) -> DataFrame:
    sc = s.SCRIPTS.df(spark)
    pairs = _pairs(sc, "script").join(F.broadcast(TYPES.df(spark).toDF("kind_a", "kind_b", "d")), ["kind_a", "kind_b"], "left")
    kind = F.when(F.col("kind_a") == F.col("kind_b"), 0.0).otherwise(F.coalesce("d", F.lit(0.5)))
    shared = F.when((F.size("ancestors_a") == 0) | (F.size("ancestors_b") == 0), 0.0).otherwise(_jaccard("ancestors_a", "ancestors_b", 0.0))
    total = 0.40 * kind + 0.15 * (F.col("direction_a") != F.col("direction_b")).cast("double") + 0.15 * F.abs(F.col("vowels_a") - F.col("vowels_b")) / 3.0 + 0.05 * (F.col("has_case_a") != F.col("has_case_b")).cast("double") + 0.25 * (1 - shared)
    return pairs.select("script_a", "script_b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("d"))


def script_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark).select("script_a", "script_b", F.round("d", 9).alias("distance"))


#: Years over which the weight of a step falls to 1/e.
DECAY = 1000.0


def _ancestry(spark: SparkSession, max_depth: int = 10, decayed: bool = False) -> DataFrame:
    """code, ancestor, weight: the strongest product of weights over all paths of at most max_depth further steps.

    Decayed, a step loses weight with the years from the ancestor's end (or
    start, where that is open) to the start of the spec below it.
    """
    edges = s.EDGES.df(spark).select("code", "ancestor", "weight")
    if decayed:
        spans = s.SPECS.df(spark).select("code", "start_year", F.coalesce("end_year", "start_year").alias("end"))
        edges = edges.join(F.broadcast(spans.select("code", "start_year")), "code", "left").join(F.broadcast(spans.select(F.col("code").alias("ancestor"), "end")), "ancestor", "left")
        gap = F.greatest(F.coalesce(F.col("start_year") - F.col("end"), F.lit(0)), F.lit(0))
        edges = edges.select("code", "ancestor", (F.col("weight") * F.exp(-gap / DECAY)).alias("weight"))
    return spark.sql(
        "WITH RECURSIVE r AS (SELECT code, ancestor, weight, 0 AS depth FROM {edges} UNION ALL SELECT r.code, e.ancestor, r.weight * e.weight, depth + 1 FROM r JOIN {edges} e ON e.code = r.ancestor WHERE depth < {most}) SELECT code, ancestor, max(weight) AS weight FROM r GROUP BY code, ancestor",
        edges=edges, most=max_depth,
    )


def ancestry_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ancestry(spark).select("code", "ancestor", F.round("weight", 9).alias("weight"))


def ancestry_weights_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ancestry(spark, decayed=True).select("code", "ancestor", F.round("weight", 9).alias("weight"))


def _similarity(spark: SparkSession) -> DataFrame:
    """code_a, code_b, similarity of pairs of listed specs: the best product over shared ancestors, or a direct path if that is stronger."""
    w = _ancestry(spark)
    pairs = _pairs(s.SPECS.df(spark).where("not clade").select("code"))
    x, y = w.toDF("code_a", "ancestor", "wa"), w.toDF("code_b", "ancestor", "wb")
    shared = x.join(y, "ancestor").where("code_a < code_b").groupBy("code_a", "code_b").agg(F.max(F.col("wa") * F.col("wb")).alias("shared"))
    up, down = w.toDF("code_b", "code_a", "up"), w.toDF("code_a", "code_b", "down")
    both = pairs.join(shared, ["code_a", "code_b"], "left").join(up, ["code_a", "code_b"], "left").join(down, ["code_a", "code_b"], "left")
    return both.select("code_a", "code_b", F.coalesce(F.greatest("up", F.coalesce("shared", F.lit(0.0)), F.when(F.col("up").isNull(), F.col("down"))), F.lit(0.0)).alias("similarity"))


def ancestry_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarity(spark).select("code_a", "code_b", F.round("similarity", 9).alias("similarity"))


def orthographic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.6 of the script distance and 0.4 of the grapheme divergence; the latter alone within one script."""
    named = s.SPECS.df(spark).where("not clade").select("code", "script")
    pairs = _pairs(named).withColumn("script_1", F.least("script_a", "script_b")).withColumn("script_2", F.greatest("script_a", "script_b"))
    scripts = _scripts(spark).toDF("script_1", "script_2", "script")
    both = pairs.join(F.broadcast(scripts), ["script_1", "script_2"], "left").join(_divergence(spark), ["code_a", "code_b"], "left")
    script = F.when(F.col("script_a") == F.col("script_b"), 0.0).otherwise(F.coalesce("script", F.lit(0.5)))
    g = F.coalesce("divergence", F.lit(1.0))
    return both.select("code_a", "code_b", F.round(F.when(script == 0, g).otherwise(0.6 * script + 0.4 * g), 9).alias("distance"))


def positional_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all graphemes with positional readings of either language: what their first readings by position differ in, 1 where one has none."""
    first = s.POSITIONAL.df(spark).groupBy("lang", "grapheme", "position").agg(F.min("ipa").alias("ipa"))
    langs = first.select(F.col("lang").alias("code")).distinct()
    x, y = first.toDF("code_a", "grapheme", "position", "a"), first.toDF("code_b", "grapheme", "position", "b")
    pairs = _pairs(langs)
    ours, theirs = pairs.join(x, "code_a"), pairs.join(y, "code_b")
    at = ["code_a", "code_b", "grapheme"]
    slots = ours.join(theirs, [*at, "position"], "full").join(F.broadcast(_phone_pairs(spark)), ["a", "b"], "left")
    d = F.when(F.col("a").isNull() | F.col("b").isNull(), 1.0).when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("d", F.lit(1.0)))
    per = slots.groupBy(*at).agg(F.when((F.count("a") == 0) | (F.count("b") == 0), 1.0).otherwise(F.avg(d)).alias("d"))
    return per.groupBy("code_a", "code_b").agg(F.round(F.least(F.lit(1.0), F.avg("d")), 9).alias("divergence"))


def family_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the clades above each spec, outermost first."""
    up = _ancestor_steps(spark).where("depth > 0").join(s.SPECS.df(spark).where("clade").select(F.col("code").alias("ancestor"), "name"), "ancestor")
    rows = up.groupBy("code").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("k"), "name"))).alias("xs"))
    return rows.select("code", F.array_join(F.transform("xs", lambda x: x["name"]), " > ").alias("family"))


#: What a user may ask the list of languages for.
FAMILY_KEYS = Inline("family_keys", "key string", (("root",), (" Branch ",), ("ROOT > BRANCH",), ("old",), ("nowhere",)))


def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, code: the specs whose whole family, or any one step of it, is the key, whatever its case."""
    rows = s.SPECS.df(spark).where("not clade").select("code").join(family_path(spark, sf_dir), "code")
    asked = FAMILY_KEYS.df(spark).withColumn("asked", F.lower(F.trim("key")))
    steps = F.transform(F.split(F.lower("family"), ">"), lambda x: F.trim(x))
    names = rows.select("code", F.explode(F.array_distinct(F.concat(F.array(F.lower("family")), steps))).alias("asked"))
    return names.join(F.broadcast(asked), "asked").select("key", "code")


#: Replacements of sandhi rules, with references to what they matched.
TRANSFORMS = Inline("transforms", "rule string, transform string", (("liaison", "\\1‿z"), ("named", "\\g<left>‿\\g<2>"), ("far", "n\\12t"), ("plain", "z"), ("empty", ""), ("slash", "a\\.b\\1"), ("none", None)))


def sandhi_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that a rule adds: its replacement without references and backslashes."""
    bare = F.regexp_replace(F.coalesce("transform", F.lit("")), r"\\g<[^>]*>|\\[0-9]+", "")
    return TRANSFORMS.df(spark).select("rule", F.translate(bare, "\\", "").alias("literals"))


def phoneme_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, phoneme, place, value: the feature vector of each reading that is a known phone; unknown features are 0.5."""
    known = F.broadcast(PHONES.df(spark).where("known").select(F.col("phone").alias("phoneme"), "features"))
    rows = resolved_graphemes(spark).select("code", F.col("ipa").alias("phoneme")).distinct().join(known, "phoneme")
    return rows.select("code", "phoneme", F.posexplode("features").alias("place", "value"))


def nearest_data_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = _ancestor_steps(spark).where("depth > 0").join(s.SPECS.df(spark).where("not clade").select(F.col("code").alias("ancestor")), "ancestor")
    return up.groupBy("code").agg(F.min_by("ancestor", "depth").alias("ancestor"))


def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = s.SPECS.df(spark).where("lat is not null").select("code", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"))
    h = F.pow(F.sin((F.col("lat_b") - F.col("lat_a")) / 2), 2) + F.cos("lat_a") * F.cos("lat_b") * F.pow(F.sin((F.col("lon_b") - F.col("lon_a")) / 2), 2)
    km = 2 * RADIUS * F.asin(F.sqrt(h))
    return _pairs(at).select("code_a", "code_b", F.round(km, 6).alias("km"), F.round(km / (math.pi * RADIUS), 9).alias("normalised"))


def temporal_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less the overlap over the span of both; an open end is the year 2025; null without years."""
    t = s.SPECS.df(spark).where("not clade and start_year is not null").select("code", F.col("start_year").alias("lo"), F.coalesce("end_year", F.lit(2025)).alias("hi"))
    overlap = F.greatest(F.lit(0), F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"))
    span = F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b")
    return _pairs(t).select("code_a", "code_b", F.round(1 - overlap / span, 9).alias("distance"))


def dead_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules none of whose phonemes the spec can produce."""
    rules, inv = s.SPEC_RULES.df(spark), resolved_graphemes(spark).select("code", F.col("ipa").alias("phoneme")).distinct()
    alive = rules.join(inv, ["code", "phoneme"], "left_semi").select("code", "rule").distinct()
    return rules.select("code", "rule").distinct().join(alive, ["code", "rule"], "left_anti")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.SPECS.df(spark).where("not clade").join(family_path(spark, sf_dir), "code", "left")
    return rows.groupBy(F.coalesce("family", F.lit("Isolate")).alias("family")).agg(F.array_join(F.array_sort(F.collect_list("code")), " ").alias("codes"))


def tag_alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias, then exact, then case-folded, then the language's default; else unchanged."""
    catalog = s.TAG_CATALOG.df(spark).select("code")
    t = s.TAGS.df(spark).join(F.broadcast(s.TAG_ALIASES.df(spark).toDF("alias", "by_alias")), F.lower("tag") == F.col("alias"), "left")
    t = t.withColumn("now", F.coalesce("by_alias", "tag"))
    t = t.join(F.broadcast(catalog.select(F.lower("code").alias("folded"), F.col("code").alias("exact"))), F.lower("now") == F.col("folded"), "left")
    t = t.join(F.broadcast(s.TAG_DEFAULTS.df(spark).toDF("lang", "default")), F.lower("now") == F.col("lang"), "left")
    return t.select("tag", F.coalesce("exact", "default", "now").alias("resolved"))


def _tag_distance(spark: SparkSession) -> DataFrame:
    """Language 100, other territory 4, missing territory 1, of each tag to each catalog entry."""
    alias = s.TAG_ALIASES.df(spark).toDF("alias", "by_alias")
    t = s.TAGS.df(spark).join(F.broadcast(alias), F.lower("tag") == F.col("alias"), "left").withColumn("now", F.lower(F.coalesce("by_alias", "tag")))
    part = lambda c, k: F.get(F.split(c, "-"), k)
    c = s.TAG_CATALOG.df(spark).withColumn("low", F.lower("code"))
    d = F.when(part("now", 0) != part("low", 0), 100).when(F.col("now") == F.col("low"), 0).when(part("now", 1).isNull(), 1).otherwise(4)
    return t.crossJoin(F.broadcast(c)).select("tag", "code", "place", d.alias("distance"))


def nearest_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest entry within 10; ties to the first in order."""
    near = _tag_distance(spark).where("distance <= 10").groupBy("tag").agg(F.min(F.struct("distance", "place", "code")).alias("top"))
    return near.select("tag", F.col("top.code").alias("closest"), F.col("top.distance").alias("distance"))


def weight_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress from the end: superheavy final, heavy penult, else antepenult, within the word."""
    w = SYLLABLE_WEIGHTS.df(spark)
    n = F.size("weights")
    last, penult = F.get("weights", n - 1), F.get("weights", n - 2)
    at = F.when(last == "superheavy", -1).when((n > 1) & ((penult != "light") | (n == 2)), -2).otherwise(-3)
    return w.select("word", F.greatest(at, -n).alias("stress"))


def slot_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, or minus the log of the weight's share where all of a grapheme's weights are given."""
    w = s.WEIGHTS.df(spark)
    sums = w.groupBy("grapheme").agg(F.sum("weight").alias("total"), F.count("weight").alias("given"), F.count("*").alias("n"))
    cost = F.when(F.col("given") == F.col("n"), -F.log(F.greatest(F.col("weight") / F.col("total"), F.lit(1e-6)))).otherwise(F.col("rank").cast("double"))
    return w.join(F.broadcast(sums), "grapheme").select("grapheme", "rank", "ipa", F.round(cost, 9).alias("cost"))


def _phonological(spark: SparkSession) -> DataFrame:
    """code_a, code_b, feature_mean, overlap, combined: 0.6 of the inventories' feature mean and 0.4 of what their allophones do not share."""
    both = inventory_mean_min(spark, "").join(allophone_overlap(spark, ""), ["code_a", "code_b"])
    return both.withColumn("combined", 0.6 * F.col("feature_mean") + 0.4 * (1 - F.col("overlap")))


def phonological_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phonological(spark).select("code_a", "code_b", F.round("combined", 6).alias("distance"))


def full_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.6 of the phonological distance and 0.4 of what ancestry does not share."""
    both = _phonological(spark).join(_similarity(spark), ["code_a", "code_b"])
    return both.select("code_a", "code_b", F.round(0.6 * F.col("combined") + 0.4 * (1 - F.col("similarity")), 6).alias("distance"))


#: Weights of inventory, graphemes, allophones and ancestry (fixed values).
PARTS = (0.25, 0.20, 0.15, 0.40)


def weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four distances by their weights; two languages without a shared grapheme are 1 apart in that part."""
    both = _phonological(spark).join(_similarity(spark), ["code_a", "code_b"]).join(_divergence(spark), ["code_a", "code_b"], "left")
    parts = (F.col("feature_mean"), F.coalesce("divergence", F.lit(1.0)), 1 - F.col("overlap"), 1 - F.col("similarity"))
    total = sum((w * x for w, x in zip(PARTS, parts)), F.lit(0.0)) / sum(PARTS)
    return both.select("code_a", "code_b", F.round(total, 6).alias("distance"))


QUERIES = {f.__name__: f for f in (family_filter, sandhi_literals, phoneme_embeddings, ancestry_weights_decayed, ancestry_similarity, weighted_distance, orthographic_distance, positional_divergence, full_distance, spec_graphemes_resolved, missing_parents, emission_inventory, phoneme_jaccard, phoneme_coverage, segment_distance_matrix, inventory_mean_min, grapheme_divergence, spelling_divergence, allophone_overlap, tone_distance, script_distance, ancestry_weights, family_path, nearest_data_ancestor, geo_distance, temporal_distance, dead_rules, families, tag_alias_chain, nearest_tag, weight_stress, slot_costs, phonological_distance)}

_BASE = with_tables(s.SPECS, s.SPEC_GRAPHEMES, s.SPEC_ALLOPHONES, s.SPEC_RULES, s.SPEC_TONES, PHONES, WEIGHTS) + ", " + _RESOLVED_SQL
_ALL = f"{_BASE}, {_PHONE_SQL}"
_MEAN = "mm AS (SELECT x.code AS code_a, y.code AS code_b, x.ipa, min(d) AS d FROM inv x JOIN inv y ON x.code <> y.code JOIN pp ON pp.a = x.ipa AND pp.b = y.ipa GROUP BY ALL), m2 AS (SELECT code_a, code_b, avg(d) AS d FROM mm GROUP BY ALL), im AS (SELECT a.code_a, a.code_b, round((a.d + b.d) / 2, 9) AS feature_mean FROM m2 a JOIN m2 b ON a.code_a = b.code_b AND a.code_b = b.code_a WHERE a.code_a < a.code_b)"
_OVERLAP = "re AS (SELECT DISTINCT code, surface FROM spec_allophones WHERE surface NOT IN ('', '∅')), li AS (SELECT code FROM specs WHERE NOT clade), ao AS (SELECT a.code AS code_a, b.code AS code_b, (SELECT count(*) FROM re x JOIN re y USING (surface) WHERE x.code = a.code AND y.code = b.code) AS i, (SELECT count(*) FROM re x WHERE x.code = a.code) + (SELECT count(*) FROM re x WHERE x.code = b.code) AS t FROM li a JOIN li b ON a.code < b.code), ov AS (SELECT code_a, code_b, round(CASE WHEN t = 0 THEN CAST(1 AS DOUBLE) ELSE i / CAST(t - i AS DOUBLE) END, 9) AS overlap FROM ao)"
_DIVERGENCE = "bo AS (SELECT x.code AS code_a, y.code AS code_b, lower(x.grapheme) AS g, x.ipa AS a, y.ipa AS b, coalesce(d, 1) AS d FROM rg x JOIN rg y ON lower(x.grapheme) = lower(y.grapheme) AND x.code < y.code LEFT JOIN pp ON pp.a = x.ipa AND pp.b = y.ipa), pe AS (SELECT code_a, code_b, g, coalesce(avg(d), 1) AS d FROM (SELECT code_a, code_b, g, CASE WHEN a <> '' THEN min(d) END AS d FROM bo GROUP BY code_a, code_b, g, a UNION ALL SELECT code_a, code_b, g, CASE WHEN b <> '' THEN min(d) END FROM bo GROUP BY code_a, code_b, g, b) GROUP BY ALL), gd AS (SELECT code_a, code_b, count(*) AS shared, avg(d) AS divergence FROM pe GROUP BY ALL)"
_ANCESTRY = "aq AS (SELECT code, ancestor, weight, 0 AS depth FROM edges UNION ALL SELECT aq.code, e.ancestor, aq.weight * e.weight, depth + 1 FROM aq JOIN edges e ON e.code = aq.ancestor WHERE depth < 10), aw AS (SELECT code, ancestor, max(weight) AS weight FROM aq GROUP BY ALL)"
_SIMILAR = "sh AS (SELECT x.code AS code_a, y.code AS code_b, max(x.weight * y.weight) AS shared FROM aw x JOIN aw y USING (ancestor) WHERE x.code < y.code GROUP BY ALL), si AS (SELECT a.code AS code_a, b.code AS code_b, CASE WHEN u.weight IS NOT NULL THEN greatest(u.weight, coalesce(shared, 0)) WHEN w.weight IS NOT NULL THEN greatest(w.weight, coalesce(shared, 0)) ELSE least(coalesce(shared, 0), 1) END AS similarity FROM specs a JOIN specs b ON a.code < b.code AND NOT a.clade AND NOT b.clade LEFT JOIN sh ON sh.code_a = a.code AND sh.code_b = b.code LEFT JOIN aw u ON u.code = b.code AND u.ancestor = a.code LEFT JOIN aw w ON w.code = a.code AND w.ancestor = b.code)"
_SCRIPT = "SELECT a.script AS script_a, b.script AS script_b, greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) * CASE WHEN a.kind = b.kind THEN 0 ELSE coalesce(d, 0.5) END + CAST(0.15 AS DOUBLE) * (a.direction <> b.direction)::INT + CAST(0.15 AS DOUBLE) * abs(a.vowels - b.vowels) / CAST(3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (a.has_case <> b.has_case)::INT + CAST(0.25 AS DOUBLE) * (1 - CASE WHEN len(a.ancestors) = 0 OR len(b.ancestors) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(a.ancestors, b.ancestors)) / CAST(len(list_distinct(list_concat(a.ancestors, b.ancestors))) AS DOUBLE) END))) AS d FROM scripts a JOIN scripts b ON a.script < b.script LEFT JOIN type_distance t ON t.a = a.kind AND t.b = b.kind"
ORACLE_SQL = {
    "spec_graphemes_resolved": f"{_BASE} SELECT code, grapheme, rank, ipa FROM rg",
    "missing_parents": f"{with_tables(s.SPECS)} SELECT code, parent FROM specs WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM specs)",
    "emission_inventory": f"{with_tables(s.GRAPHEMES, s.POSITIONAL, s.ENDINGS, s.LEXICON, s.ALLOPHONE_RULES)} SELECT * FROM (SELECT lang, ipa FROM graphemes UNION SELECT lang, ipa FROM positional_rows UNION SELECT lang, ipa FROM endings UNION SELECT lang, ipa FROM lexicon UNION SELECT lang, surface FROM allophone_rules) WHERE ipa <> ''",
    "phoneme_jaccard": f"{_BASE}, c AS (SELECT a.code AS code_a, b.code AS code_b, count(*) FILTER (a.ipa = b.ipa) AS shared, count(DISTINCT a.ipa) + count(DISTINCT b.ipa) AS t FROM inv a JOIN inv b ON a.code < b.code GROUP BY ALL) SELECT code_a, code_b, CAST(shared AS INTEGER) AS shared, round(1 - shared / CAST(t - shared AS DOUBLE), 9) AS jaccard_distance FROM c",
    "phoneme_coverage": f"{_BASE} SELECT a.code AS native, b.code AS target, round(count(*) FILTER (a.ipa = b.ipa) / CAST(count(DISTINCT b.ipa) AS DOUBLE), 9) AS coverage FROM inv a JOIN inv b ON a.code <> b.code GROUP BY ALL",
    "segment_distance_matrix": f"{_ALL} SELECT a, b, round(d, 9) AS distance FROM pp",
    "inventory_mean_min": f"{_ALL}, {_MEAN} SELECT * FROM im",
    "grapheme_divergence": f"{_ALL}, {_DIVERGENCE} SELECT code_a, code_b, shared, round(divergence, 9) AS divergence FROM gd",
    "spelling_divergence": f"{_BASE}, gs AS (SELECT code, ipa, list_sort(list_distinct(list(lower(grapheme)))) AS xs FROM rg GROUP BY ALL) SELECT a.code AS code_a, b.code AS code_b, count(*) AS shared, round(avg(1 - len(list_intersect(a.xs, b.xs)) / CAST(len(list_distinct(list_concat(a.xs, b.xs))) AS DOUBLE)), 9) AS divergence FROM gs a JOIN gs b ON a.ipa = b.ipa AND a.code < b.code GROUP BY ALL",
    "allophone_overlap": f"{_BASE}, {_OVERLAP} SELECT * FROM ov",
    "tone_distance": f"{with_tables(s.SPECS, s.SPEC_TONES)}, li AS (SELECT code FROM specs WHERE NOT clade), k AS (SELECT a.code AS code_a, b.code AS code_b, (SELECT count(*) FROM spec_tones x JOIN spec_tones y USING (tone) WHERE x.code = a.code AND y.code = b.code) AS i, (SELECT count(*) FROM spec_tones x WHERE x.code = a.code OR x.code = b.code) AS t FROM li a JOIN li b ON a.code < b.code) SELECT code_a, code_b, round(CASE WHEN t = 0 THEN CAST(0 AS DOUBLE) ELSE 1 - i / CAST(t - i AS DOUBLE) END, 9) AS distance FROM k",
    "script_distance": f"{with_tables(s.SCRIPTS, TYPES)} SELECT script_a, script_b, round(d, 9) AS distance FROM ({_SCRIPT})",
    "ancestry_weights": f"{with_tables(s.EDGES)}, {_ANCESTRY} SELECT code, ancestor, round(weight, 9) AS weight FROM aw",
    "ancestry_weights_decayed": f"{with_tables(s.EDGES, s.SPECS)}, ed AS (SELECT e.code, e.ancestor, e.weight * exp(-greatest(coalesce(d.start_year - coalesce(k.end_year, k.start_year), 0), 0) / CAST({DECAY!r} AS DOUBLE)) AS weight FROM edges e LEFT JOIN specs d ON d.code = e.code LEFT JOIN specs k ON k.code = e.ancestor), {_ANCESTRY.replace('edges', 'ed')} SELECT code, ancestor, round(weight, 9) AS weight FROM aw",
    "family_filter": f"{with_tables(s.SPECS, FAMILY_KEYS)}, {_STEPS_SQL}, f AS (SELECT st.code, string_agg(k.name, ' > ' ORDER BY depth DESC) AS family FROM st JOIN specs k ON k.code = st.ancestor AND k.clade WHERE depth > 0 GROUP BY st.code) SELECT key, code FROM f JOIN specs USING (code) JOIN family_keys ON lower(family) = lower(trim(key)) OR EXISTS (SELECT 1 FROM (SELECT unnest(string_split(family, '>')) AS step) WHERE lower(trim(step)) = lower(trim(key))) WHERE NOT clade",
    "sandhi_literals": f"{with_tables(TRANSFORMS)} SELECT rule, replace(regexp_replace(coalesce(transform, ''), '\\\\g<[^>]*>|\\\\[0-9]+', '', 'g'), '\\', '') AS literals FROM transforms",
    "phoneme_embeddings": f"{_BASE} SELECT code, ipa AS phoneme, CAST(place AS INTEGER) AS place, features[place + 1] AS value FROM inv JOIN phones ON phone = ipa AND known JOIN (SELECT unnest(range(0, {len(p.FEATURES)})) AS place) ON true",
    "ancestry_similarity": f"{with_tables(s.EDGES, s.SPECS)}, {_ANCESTRY}, {_SIMILAR} SELECT code_a, code_b, round(similarity, 9) AS similarity FROM si",
    "orthographic_distance": f"{with_tables(s.SPECS, s.SPEC_GRAPHEMES, PHONES, WEIGHTS, s.SCRIPTS, TYPES)}, {_RESOLVED_SQL}, {_PHONE_SQL}, {_DIVERGENCE}, sd AS ({_SCRIPT}), od AS (SELECT a.code AS code_a, b.code AS code_b, CASE WHEN a.script = b.script THEN CAST(0 AS DOUBLE) ELSE coalesce(sd.d, CAST(0.5 AS DOUBLE)) END AS sc, coalesce(gd.divergence, CAST(1 AS DOUBLE)) AS g FROM specs a JOIN specs b ON a.code < b.code AND NOT a.clade AND NOT b.clade LEFT JOIN sd ON sd.script_a = least(a.script, b.script) AND sd.script_b = greatest(a.script, b.script) LEFT JOIN gd ON gd.code_a = a.code AND gd.code_b = b.code) SELECT code_a, code_b, round(CASE WHEN sc = 0 THEN g ELSE CAST(0.6 AS DOUBLE) * sc + CAST(0.4 AS DOUBLE) * g END, 9) AS distance FROM od",
    "positional_divergence": f"{with_tables(s.POSITIONAL, PHONES, WEIGHTS)}, {_PHONE_SQL}, fi AS (SELECT lang, grapheme, position, min(ipa) AS ipa FROM positional_rows GROUP BY ALL), la AS (SELECT DISTINCT lang FROM fi), pr AS (SELECT a.lang AS code_a, b.lang AS code_b FROM la a JOIN la b ON a.lang < b.lang), gr AS (SELECT code_a, code_b, grapheme, position FROM pr JOIN fi ON fi.lang = code_a UNION SELECT code_a, code_b, grapheme, position FROM pr JOIN fi ON fi.lang = code_b), sl AS (SELECT gr.*, x.ipa AS a, y.ipa AS b, CASE WHEN x.ipa IS NULL OR y.ipa IS NULL THEN 1 WHEN x.ipa = y.ipa THEN 0 ELSE coalesce(pp.d, 1) END AS d FROM gr LEFT JOIN fi x ON x.lang = code_a AND x.grapheme = gr.grapheme AND x.position = gr.position LEFT JOIN fi y ON y.lang = code_b AND y.grapheme = gr.grapheme AND y.position = gr.position LEFT JOIN pp ON pp.a = x.ipa AND pp.b = y.ipa), pe AS (SELECT code_a, code_b, grapheme, CASE WHEN count(a) = 0 OR count(b) = 0 THEN CAST(1 AS DOUBLE) ELSE avg(d) END AS d FROM sl GROUP BY ALL) SELECT code_a, code_b, round(least(CAST(1 AS DOUBLE), avg(d)), 9) AS divergence FROM pe GROUP BY ALL",
    "full_distance": f"{_ALL.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + s.EDGES.sql() + ', ', 1)}, {_MEAN}, {_OVERLAP}, {_ANCESTRY}, {_SIMILAR} SELECT code_a, code_b, round(CAST(0.6 AS DOUBLE) * (CAST(0.6 AS DOUBLE) * feature_mean + CAST(0.4 AS DOUBLE) * (1 - overlap)) + CAST(0.4 AS DOUBLE) * (1 - similarity), 6) AS distance FROM im JOIN ov USING (code_a, code_b) JOIN si USING (code_a, code_b)",
    "weighted_distance": f"{_ALL.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + s.EDGES.sql() + ', ', 1)}, {_MEAN}, {_OVERLAP}, {_ANCESTRY}, {_SIMILAR}, {_DIVERGENCE} SELECT im.code_a, im.code_b, round(CAST(0.25 AS DOUBLE) * feature_mean + CAST(0.2 AS DOUBLE) * coalesce(divergence, 1) + CAST(0.15 AS DOUBLE) * (1 - overlap) + CAST(0.4 AS DOUBLE) * (1 - similarity), 6) AS distance FROM im JOIN ov USING (code_a, code_b) JOIN si USING (code_a, code_b) LEFT JOIN gd USING (code_a, code_b)",
    "family_path": f"{with_tables(s.SPECS)}, {_STEPS_SQL} SELECT st.code, string_agg(k.name, ' > ' ORDER BY depth DESC) AS family FROM st JOIN specs k ON k.code = st.ancestor AND k.clade WHERE depth > 0 GROUP BY st.code",
    "nearest_data_ancestor": f"{with_tables(s.SPECS)}, {_STEPS_SQL} SELECT st.code, arg_min(ancestor, depth) AS ancestor FROM st JOIN specs k ON k.code = st.ancestor AND NOT k.clade WHERE depth > 0 GROUP BY st.code",
    "geo_distance": f"{with_tables(s.SPECS)}, g AS (SELECT a.code AS code_a, b.code AS code_b, 2 * CAST({RADIUS!r} AS DOUBLE) * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM specs a JOIN specs b ON a.code < b.code WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL) SELECT code_a, code_b, round(km, 6) AS km, round(km / (pi() * CAST({RADIUS!r} AS DOUBLE)), 9) AS normalised FROM g",
    "temporal_distance": f"{with_tables(s.SPECS)}, t AS (SELECT code, start_year AS lo, coalesce(end_year, 2025) AS hi FROM specs WHERE NOT clade AND start_year IS NOT NULL) SELECT a.code AS code_a, b.code AS code_b, round(1 - greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / CAST(greatest(a.hi, b.hi) - least(a.lo, b.lo) AS DOUBLE), 9) AS distance FROM t a JOIN t b ON a.code < b.code",
    "dead_rules": f"{_BASE} SELECT DISTINCT code, rule FROM spec_rules r WHERE NOT EXISTS (SELECT 1 FROM spec_rules q JOIN inv ON inv.code = q.code AND inv.ipa = q.phoneme WHERE q.code = r.code AND q.rule = r.rule)",
    "families": f"{with_tables(s.SPECS)}, {_STEPS_SQL}, f AS (SELECT st.code, string_agg(k.name, ' > ' ORDER BY depth DESC) AS family FROM st JOIN specs k ON k.code = st.ancestor AND k.clade WHERE depth > 0 GROUP BY st.code) SELECT coalesce(family, 'Isolate') AS family, string_agg(code, ' ' ORDER BY code) AS codes FROM specs LEFT JOIN f USING (code) WHERE NOT clade GROUP BY 1",
    "tag_alias_chain": f"{with_tables(s.TAGS, s.TAG_ALIASES, s.TAG_DEFAULTS, s.TAG_CATALOG)}, n AS (SELECT tag, coalesce(a.code, tag) AS now FROM tags LEFT JOIN tag_aliases a ON a.alias = lower(tag)) SELECT tag, coalesce(c.code, d.code, now) AS resolved FROM n LEFT JOIN tag_catalog c ON lower(c.code) = lower(now) LEFT JOIN tag_defaults d ON d.lang = lower(now)",
    "nearest_tag": f"{with_tables(s.TAGS, s.TAG_ALIASES, s.TAG_CATALOG)}, n AS (SELECT tag, lower(coalesce(a.code, tag)) AS now FROM tags LEFT JOIN tag_aliases a ON a.alias = lower(tag)), x AS (SELECT tag, code, place, CASE WHEN split_part(now, '-', 1) <> split_part(lower(code), '-', 1) THEN 100 WHEN now = lower(code) THEN 0 WHEN split_part(now, '-', 2) = '' THEN 1 ELSE 4 END AS distance FROM n CROSS JOIN tag_catalog) SELECT tag, arg_min(code, (distance, place)) AS closest, min(distance) AS distance FROM x WHERE distance <= 10 GROUP BY tag",
    "weight_stress": f"{with_tables(SYLLABLE_WEIGHTS)} SELECT word, greatest(CASE WHEN weights[-1] = 'superheavy' THEN -1 WHEN len(weights) > 1 AND (weights[-2] <> 'light' OR len(weights) = 2) THEN -2 ELSE -3 END, -CAST(len(weights) AS INTEGER)) AS stress FROM syllable_weights",
    "slot_costs": f"{with_tables(s.WEIGHTS)} SELECT grapheme, rank, ipa, round(CASE WHEN count(weight) OVER g = count(*) OVER g THEN -ln(greatest(weight / sum(weight) OVER g, 1e-6)) ELSE CAST(rank AS DOUBLE) END, 9) AS cost FROM weights WINDOW g AS (PARTITION BY grapheme)",
    "phonological_distance": f"{_ALL}, {_MEAN}, {_OVERLAP} SELECT code_a, code_b, round(CAST(0.6 AS DOUBLE) * feature_mean + CAST(0.4 AS DOUBLE) * (1 - overlap), 6) AS distance FROM im JOIN ov USING (code_a, code_b)",
}
