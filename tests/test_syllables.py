import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphonic.functions import arabic, conformance, engine, tones
from graphonic.functions import syllables as y
from graphonic.functions.phones import is_vowel
from graphonic.operators.syllables import SYSTEM, computed_tones, spec_errors
from graphonic.sources import validation as v

READINGS = st.text("aeioupbtdkgszlrmnjwː", max_size=12)


@settings(max_examples=200, deadline=None)
@given(READINGS, st.integers(0, 3))
def test_every_cut_joins_to_the_reading(ipa, most):
    parts = y.syllabify_ipa(ipa, most)
    assert "".join(parts) == ipa
    whole = y.syllabify(ipa, is_vowel, ["ai", "au"], [1])
    assert "".join(whole) == ipa
    assert "".join(y.rebalance(whole)) == ipa and "".join(y.capture_liquids(whole)) == ipa


def test_ipa_syllables():
    assert y.syllabify_ipa("astra", 1) == ["ast", "ra"]
    assert y.syllabify_ipa("astra", 2) == ["as", "tra"]
    assert y.syllabify_ipa("str") == ["str"] and y.syllabify_ipa("") == []


def test_nuclei_and_hiatus():
    assert y.syllabify("kauan", is_vowel, ["au"]) == ["kau", "an"]
    assert y.syllabify("kauan", is_vowel, ["au"], [2]) == ["ka", "u", "an"]
    assert y.syllabify("astra", is_vowel) == ["a", "stra"]


def test_hiatus_places():
    closed, final = y.ClosedHiatus(frozenset({"ai", "ui"}), frozenset("rl"), ("nh",)), y.FinalDiphthongs(("iu",), ("s",))
    assert y.hiatus_candidates("rainha", closed) == {2}
    assert y.hiatus_candidates("sair", closed) == {2} and y.hiatus_candidates("saira", closed) == set()
    assert y.hiatus_candidates("sailho", closed, graphemes=["lh"]) == set()
    assert y.hiatus_candidates("caiu", None, final) == y.hiatus_candidates("caius", None, final) == {2}
    assert y.hiatus_candidates("") == y.hiatus_candidates("iu", None, final) == set()
    divide = lambda w, places: y.syllabify(w, is_vowel, ["ai"], places)
    assert y.hiatus_places("sair", divide, lambda parts: len(parts) - 1, {2}) == {2}
    assert y.hiatus_places("sair", divide, lambda parts: 0, {2}) == set()


def test_nested_models():
    kinds = lambda **x: [(e[0], e[2]) for e in v.validate(__import__("json").dumps({"code": "a", "name": "A", "script": "Latin", **x}))]
    rule = {"id": "r", "name": "R", "left_context": "", "right_context": ""}
    assert kinds(sandhi_rules=[rule, {**rule, "transform": "x"}]) == [("sandhi_rules.0", "value_error")]
    assert kinds(allophone_rules=[{"id": "", "phonemes": 3}]) == [("allophone_rules.0.id", "string_too_short"), ("allophone_rules.0.phonemes", "string_type")]
    assert kinds(allophone_rules=[{"id": "r", "phonemes": "a", "surface": "b", "append": "c"}]) == [("allophone_rules.0", "value_error")]
    assert kinds(allophone_rules=[{"id": "r", "phonemes": ["a"], "mutates_neighbor": "b"}]) == [("allophone_rules.0", "value_error")]
    assert kinds(ancestors=[{"code": "b", "role": "parent", "weight": 2}]) == [("ancestors.0.weight", "value_error")]
    assert kinds(timespan={"start_year": 1500, "end_year": "1400"}) == [("timespan.end_year", "value_error")]
    assert kinds(timespan={"start_year": 1500, "end_year": None}) == []
    assert kinds(sources=[{"id": "s", "author": "A", "year": 99, "title": "T", "doi": "x"}]) == [("sources.0.year", "value_error"), ("sources.0.doi", "value_error")]
    assert kinds(valid_ceiling={"x": {"per": 1.5, "folded": "f", "citation": "c"}}) == [("valid_ceiling.x.per", "less_than_equal")]
    assert kinds(audit={"x": {"conclusion": "no", "measured": "m", "reference": "r"}}) == [("audit.x.conclusion", "literal_error")]


def test_onsets():
    assert y.rebalance(["a", "stra"]) == ["a", "stra"]
    assert y.rebalance(["a", "lta"]) == ["al", "ta"]
    assert y.rebalance(["a", "tna"], ["tn"]) == ["a", "tna"]
    assert y.rebalance(["a", "stra"], most=2) == ["as", "tra"]
    assert y.capture_liquids(["ka", "rta", "lja"]) == ["kar", "ta", "lja"]


def test_length():
    assert y.iambic_length("takata") == "takaːta"
    assert y.iambic_length("taka") == "taka" and y.iambic_length("taːkata") == "taːkata"


def test_stress():
    parts = ["pa", "ki", "tu"]
    assert y.stress_mark("pakitu", -2, parts) == "paˈkitu"
    assert y.stress_mark("pakitu", 0, y.fold_inserted(parts, [3]), 2) == "ˈpakitu"
    assert y.stress_mark("paˈkitu", 0, parts) == "paˈkitu"
    assert y.stress_mark("kanəta", 0, ["ka", "nə", "ta"], 2) == "ˈkanəta"
    assert y.stress_mark("pakitula", 3, ["pa", "ki", "tu", "la"], secondary=[1]) == "paˌkituˈla"


def test_a_failing_syllabifier_is_not_taken():
    own = lambda w: [w]
    assert y.syllables_for("kata", "zz", own, lambda w, lang: ["ka", "ta"]) == ["ka", "ta"]
    assert y.syllables_for("kata", "zz", own, lambda w, lang: ["KA", "ta"]) == ["kata"]
    assert y.syllables_for("kata", "zz", own, lambda w, lang: 1 / 0) == ["kata"]


def test_arabic_letters_are_the_letters_of_the_blocks():
    blocks = [*range(0x600, 0x700), *range(0x750, 0x780), *range(0x870, 0x900)]
    letters = {c for k in blocks if unicodedata.category(c := chr(k)) == "Lo"}
    assert letters == {c for k in blocks if re.fullmatch(arabic.LETTER, c := chr(k)) and unicodedata.category(c) != "Cn"}


def test_arabic():
    assert arabic.doubled("رِّس") == arabic.doubled("رِّس") == "ررِس"
    assert arabic.doubled("شدّ") == "شدد"
    assert arabic.plain_forms("\ufefb") == "\u0644\u0627" and arabic.plain_forms("\ufb01") == "\ufb01"


def test_tones(spark, sf):
    assert [tones.shape(x, SYSTEM) for x in ("kat", "kaːt", "ka", "kaː", "kam", "st")] == ["dead_short", "dead_long", "dead_short", "live", "live", None]
    got = {r.word: r.ipa for r in computed_tones(spark, sf).collect()}
    assert got == {"ka": "ka˨˩", "kat": "kat˨˩", "kaam": "kaːm˧", "h1an": "han˨˩", "kahin": "ka˨˩hin˩˩˦", "st": "st"}


def test_coercion():
    assert [v.to_int(x) for x in ("2", True, 2.0, " 3 ")] == [2, 1, 2, 3]
    assert [v.to_bool(x) for x in ("yes", "OFF", 1, 0.0)] == [True, False, True, False]
    for f, x, kind in ((v.to_int, 2.5, "int_from_float"), (v.to_int, "x", "int_parsing"), (v.to_bool, 2, "bool_parsing"), (v.to_bool, None, "bool_type"), (v.to_str, 3, "string_type"), (v.to_float, "x", "float_parsing")):
        with pytest.raises(v.Invalid) as e:
            f(x)
        assert e.value.args[1] == kind


def test_spec_errors(spark, sf):
    kinds = [(e[0], e[2]) for e in v.validate('{"extra": 1, "code": "bb", "script": 3, "iso639_3": "BB1"}')]
    assert kinds == [("name", "missing"), ("script", "string_type"), ("iso639_3", "string_pattern_mismatch"), ("extra", "extra_forbidden")]
    assert v.validate(None)[0][2] == "json_invalid" and v.validate("[]")[0][2] == "model_type"
    lines = sorted(r.line for r in spec_errors(spark, sf).collect())
    assert len(lines) == 8 and not any(x.startswith("aa") for x in lines)


def test_conformance():
    own = engine.own_engine("es")
    conformance.assert_rescorer_conforms(lambda slots, tokens: slots, own)
    conformance.assert_syllabifier_conforms(lambda w, lang: y.syllabify_ipa(w), own, ["kasa", "pato"], ["es"])
    with pytest.raises(conformance.ConformanceError, match="inventory"):
        conformance.assert_rescorer_conforms(lambda slots, tokens: [[engine.Candidate("ǁ", 0.0)] for _ in slots], own)
    with pytest.raises(conformance.ConformanceError, match="join"):
        conformance.assert_syllabifier_conforms(lambda w, lang: ["x"], own)
    with pytest.raises(conformance.ConformanceError, match="claim"):
        conformance.assert_syllabifier_conforms(lambda w, lang: [w], own, codes=["de"])
    with pytest.raises(conformance.ConformanceError, match="changes"):
        conformance.assert_syllabifier_conforms(lambda w, lang: [w], own, ["casa"])
