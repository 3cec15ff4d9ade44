from pyspark.sql import functions as F

from graphonic.operators import distances, specs


def test_edges_lose_marks_but_not_apostrophes(spark):
    words = {"«Bonjour»,": "Bonjour", "'tis!": "'tis", "l’eau…": "l’eau", "rock'n'roll": "rock'n'roll", "(a.b)": "a.b", "...": "", "दिल।": "दिल", "1,5%": "1,5", "’n’": "’n’"}
    df = spark.createDataFrame(list(words.items()), "raw string, want string")
    assert df.where(F.regexp_replace("raw", specs.CLINGING, "") != F.col("want")).collect() == []


def test_chain_keeps_clades_and_a_missing_parent(spark):
    got = {}
    for r in sorted(specs.ancestry_chain(spark, "").collect(), key=lambda r: r.place):
        got.setdefault(r.code, []).append(r.ancestor)
    assert got == {"zz-old": ["zz-root"], "zz-north": ["zz-old", "zz-root"], "zz-south": ["zz-old", "zz-root"], "zz-east": ["zz-branch", "zz-old", "zz-root"], "zz-branch": ["zz-old", "zz-root"], "zz-west": ["zz-north", "zz-old", "zz-root"], "zz-lost": ["zz-gone"]}


def test_position_then_plain_readings_then_none(spark):
    got = {(r.lang, r.grapheme, r.position): r.readings for r in specs.resolve_grapheme(spark, "").collect()}
    assert got["en", "c", "before_front_vowel"] == "s" and got["en", "e", "word_final"] == ""
    assert got["en", "c", "word_final"] == got["en", "c", None] != "s" and got["en", "qqq", None] is None


def test_families_match_by_step_whatever_the_case(spark):
    got = {(r.key, r.code) for r in distances.family_filter(spark, "").collect()}
    assert {c for k, c in got if k == "root"} == {"zz-old", "zz-north", "zz-south", "zz-east", "zz-west"}
    assert {(k, c) for k, c in got if k != "root"} == {(" Branch ", "zz-east"), ("ROOT > BRANCH", "zz-east")}


def test_literals_lose_references(spark):
    got = {r.rule: r.literals for r in distances.sandhi_literals(spark, "").collect()}
    assert got == {"liaison": "‿z", "named": "‿", "far": "nt", "plain": "z", "empty": "", "slash": "a.b", "none": ""}


def test_weights_fall_with_the_years_between(spark):
    got = {(r.code, r.ancestor): r.weight for r in distances.ancestry_weights_decayed(spark, "").collect()}
    assert got["zz-north", "zz-old"] == 0.8  # they overlap
    assert abs(got["zz-west", "zz-north"] - 0.7 * 2.718281828459045 ** (-100 / 1000)) < 1e-8  # 1600 to 1700
