import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphonic.functions import engine as e
from graphonic.functions import phones as p
from graphonic.functions import utterance as u


def test_segment_distance():
    assert p.segment_distance("p", "p") == 0
    assert p.segment_distance("p", "b") == pytest.approx(0.042553191489361715, abs=1e-12)
    assert p.segment_distance("", "a") == p.segment_distance("∅", "a") == 1
    assert p.phonetic_distance("a", "p") == 1 and p.phonetic_distance(" ", "a") == 1


@pytest.mark.parametrize("a, b, distance", [("r", "ɾ", 0), ("u", "y", 2 / 35), ("ə", "ɐ", 2 / 35), ("m", "ɱ", 16 / 47), ("k", "kʼ", 2 / 47), ("æ", "a", 2 / 35), ("ʔ", "q", 38 / 47), ("i", "ɨ", 2 / 35), ("s", "z", 2 / 47), ("ã", "a", 1 / 35), ("tʃ", "m̥", 40 / 47), ("g", "ɡ", 1), ("ʦ", "s", 1), ("ɝ", "ɜ˞", 0), ("a", "i", 6 / 35)])
def test_distances_worked_out_by_hand(a, b, distance):
    """Weights in 58ths: 35 are compared between vowels, 47, counted twice, between other phones."""
    assert p.segment_distance(a, b) == pytest.approx(distance, abs=1e-12)
    assert p.segment_distance(b, a) == pytest.approx(distance, abs=1e-12)


def test_phone_table():
    assert len(p.PHONES) == 118 and all(len(v) == 23 for v in p.PHONES.values())
    assert sum(p.WEIGHTS[k] for k in p.VOWEL_FEATURES) == pytest.approx(35 / 58) and sum(p.WEIGHTS[k] for k in p.CONSONANT_FEATURES) == pytest.approx(47 / 58)
    assert p.vector("tsʼ")[p.AT["constricted_glottis"]] and p.vector("ᵐb") is None


def test_feature_vector():
    v = p.feature_vector("p")
    assert len(v) == 23 and v[7] == 0.5 and v[11] == 1
    assert p.feature_vector("?") == [0.5] * 23
    assert p.vector("ã")[p.AT["nasal_vowel"]] is True


def test_candidate_costs():
    assert e.base_costs("abc", [0.1, 0.2, 0.3]) == pytest.approx([1.791759469228055, 1.0986122886681096, 0.6931471805599453], abs=1e-12)
    assert e.base_costs("abcd", [0.7, 0.1, 0.1, 0.1])[0] == pytest.approx(0.35667494393873245, abs=1e-12)
    assert e.base_costs("abc", [1e16, 1, 1])[0] == pytest.approx(2.2204460492503136e-16, rel=1e-9)
    assert e.base_costs("ab", [1, None]) == [0.0, 1.0]


def test_segments():
    assert p.segment_ipa("atɕʰa", ("tɕʰ", "tɕ")) == ["a", "tɕʰ", "a"]
    assert p.segment_ipa("k͈al") == ["k͈", "a", "l"]
    assert p.segment_ipa("tɕa", ("tɕ",)) == ["tɕ", "a"]


def test_weights_and_tones():
    assert [e.weight(p.segment_ipa(x)) for x in ("taːb", "ki", "dar")] == ["superheavy", "light", "heavy"]
    assert [e.dock_tone_marks(x) for x in ("o˧ŋ", "oŋ˧", "ai")] == ["oŋ˧", "oŋ˧", "ai"]


def test_confidence():
    assert e.slot_confidence([0]) == 1
    assert e.slot_confidence([0, 1]) == pytest.approx(0.632120559)
    assert e.slot_confidence([0.5, 1.5]) == pytest.approx(0.383400499)
    assert e.slot_confidence([]) == 0


def test_endings_give_ranked_readings():
    engine = e.Engine(e.Spec("zz", {"t": ["t"], "a": ["a"], "b": ["b"]}, endings={"ab": ["ɐ", "e"]}))
    assert engine.read("tab").ipa == "tɐ"
    assert engine.read("tab1").coverage == 0.75 and engine.read("tab1").unmapped == "1"


def test_lexicon_wins():
    engine = e.Engine(e.Spec("zz", {"t": ["t"]}, lexicon={"t": "x"}))
    assert engine.read("T").ipa == "x" and engine.read("T").confidence == 1


@settings(max_examples=100, deadline=None)
@given(st.text("abcdehiklmnoprstuvxzßäçé 1.,", max_size=15))
def test_tokenise_covers_the_text(text):
    spec = e.own_engine("de").spec
    tokens = e.tokenize(text, spec)
    assert sum(t.length for t in tokens) == len(text)
    assert all(t.grapheme in spec.graphemes for t in tokens if t.kind == "GRAPHEME")


@settings(max_examples=100, deadline=None)
@given(st.text("aeoptk˧˥ŋ", max_size=8))
def test_docking_twice_changes_nothing(ipa):
    once = e.dock_tone_marks(ipa)
    assert e.dock_tone_marks(once) == once


def test_beam_is_the_best_of_all_paths():
    from itertools import product

    slots = [[e.Candidate("a", 0), e.Candidate("b", 0.4)], [e.Candidate("c", 0.1), e.Candidate("d", 0.2)], [e.Candidate("e", 0), e.Candidate("f", 1)]]
    best = sorted((sum(c.cost for c in x), "".join(c.ipa for c in x)) for x in product(*slots))[:4]
    got = [(s, "".join(x)) for s, x in e.beam(slots, 4)]
    assert [i for _, i in got] == [i for _, i in best] and [s for s, _ in got] == pytest.approx([s for s, _ in best])


def test_sandhi_is_a_fold():
    rules = [u.Sandhi("r", r"a$", r"^b", right_transform=(r"^b", "a")), u.Sandhi("s", r"a$", r"^c", transform=(r"$", "x"))]
    assert u.sandhi(["a", "b", "c"], rules) == ["a", "ax", "c"]
    assert u.sandhi(["a", "b"], rules, [True, False]) == ["a", "b"]
    with pytest.raises(ValueError):
        u.sandhi(["a"], rules, [True, False])


def test_markup():
    assert u.parse_markup('x <phoneme alphabet="ipa" ph="ə">the</phoneme> y') == [("x ", None), ("the", "ə"), (" y", None)]
    for bad in ('<phoneme ph="ə">a</phoneme>', '<phoneme alphabet="ipa" ph="">a</phoneme>', '<phoneme alphabet="ipa" ph="ə">a b</phoneme>', "<phoneme>"):
        with pytest.raises(u.MarkupError):
            u.parse_markup(bad)


def test_dialects():
    assert u.dialect("ˈpəlɐ", "lisbon") == "ˈpəɫɐ"
    assert u.dialect("ei", "chain") == "iɨ"
    with pytest.raises(KeyError):
        u.dialect("a", "none")


def test_lattice_error_rate():
    assert u.lattice_per([["k"], ["a", "o"], ["t"]], "kot", "kat") == 0
    assert u.lattice_per([["k"], ["a"], ["t"]], "kat", "kas") == pytest.approx(1 / 3)
    assert u.lattice_per([], "", "") == 0
    assert 0 < u.lattice_per([["p"]], "p", "b", weighted=True) < 0.05


def test_tags():
    assert u.to_tag(u.parse_tag("ZH-hant-tw")) == "zh-Hant-TW"
    assert u.parse_tag("en-x-a-b")[-1] == ("private", "x-a-b")
    for bad in ("", "en--us", "en-us-latn", "1"):
        with pytest.raises(u.LanguageTagError):
            u.parse_tag(bad)


def test_lattice_confidence_bounds():
    r = e.own_engine("en").read("stingeration")
    assert 0 < r.confidence <= 1 and r.coverage == 1 and math.isfinite(r.confidence)
