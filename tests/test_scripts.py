import json

import pytest

from graphonic.__main__ import main
from graphonic.functions import engine as e
from graphonic.functions import word_end as w

VIRAMA, SIGN_I, SIGN_E = "्", "ि", "े"
DEVA = e.Spec("zz", {"क": ["k"], "म": ["m"], "ल": ["l"], SIGN_I: ["i"], SIGN_E: ["e"], "अ": ["a"]}, abugida=e.Abugida("ə", final=""))
THAI = e.Spec("zy", {"ก": ["k"], "น": ["n"], "เ": ["e"], "า": ["aː"]}, abugida=e.Abugida("a", dependent=frozenset("า"), preposed=frozenset("เ"), bare_codas=True))


def ipa(spec, text):
    return ["".join(t.ipa[:1]) for t in e.tokenize(text, spec)]


def test_inherent_vowels():
    assert ipa(DEVA, "कम") == ["kə", "m"]
    assert ipa(DEVA, "क") == ["kə"]
    assert ipa(DEVA, "कि") == ["k", "i"]
    assert ipa(DEVA, "क" + VIRAMA + "म") == ["k", "mə"]
    assert ipa(DEVA, "अ") == ["a"] and ipa(DEVA, "") == []


def test_preposed_vowels():
    assert ipa(THAI, "เกน") == ["", "ke", "n"]
    assert ipa(THAI, "เกา") == ["", "k", "aː"]
    assert ipa(THAI, "กาน") == ["k", "aː", "n"]
    assert ipa(THAI, "เ") == ["e"]


def test_token_lengths_cover_the_text():
    for spec, text in ((DEVA, "क" + VIRAMA + "मकि ल"), (THAI, "เกนกา ก")):
        assert sum(t.length for t in e.tokenize(text, spec)) == len(text)


def test_backing_off():
    spec = e.Spec("zz", {"g": ["ɡ"], "gu": ["ɡ"], "u": ["u"], "ua": ["wa"], "a": ["a"], "e": ["e"], "s": ["s"], "ew": ["eːw"], "w": ["w"]}, positional={"gu": {"before_a": ["ɡw"]}}, glide_backoff=frozenset({"ew"}))
    cut = lambda x: [t.grapheme for t in e.tokenize(x, spec)]
    assert cut("gus") == ["g", "u", "s"] and cut("gu") == ["g", "u"]
    assert cut("gue") == ["gu", "e"]
    assert cut("agua") == ["a", "g", "ua"] and cut("gua") == ["gu", "a"]
    assert cut("ewa") == ["e", "w", "a"] and cut("ews") == ["ew", "s"]


def test_nasal_marks():
    c = e.Candidate
    assert e.beam([[c("ʏ", 0)], [c(e.NASAL, 0), c("n", 1)]]) == [(0, ("ʏ" + e.NASAL, "")), (1, ("ʏ", "n"))]
    assert e.beam([[c("ɡ", 0)], [c(e.NASAL, 0), c("m", 1)]]) == [(1, ("ɡ", "m"))]
    assert e.beam([[c("uː", 0)], [c(e.NASAL, 0)]]) == [(0, ("u" + e.NASAL + "ː", ""))]
    kept = e.nasal_carriers([[c("t", 0), c("a", 1)], [c("", 0), c("d", 1)], [c(e.NASAL, 0)]])
    assert [[x.ipa for x in s] for s in kept] == [["a"], [""], [e.NASAL]]


def test_word_ends():
    spec = e.Spec("zz", {"e": ["e"], "s": ["s"], "a": ["a"], "t": ["t"], "th": ["θ"]}, positional={"e": {"word_final": [""]}, "s": {"word_final": [""]}})
    t = e.tokenize("tates", spec)
    assert w.word_end(t, 4, spec) == w.WordEnd(True, False, False)
    assert w.word_end(t, 3, spec) == w.WordEnd(False, True, True)
    assert w.is_mute_e(t, 3) and w.is_mute_e(e.tokenize("athe", spec), 2) and not w.is_mute_e(e.tokenize("te", spec), 1)
    assert w.audible("tates", spec) == "tat" and w.audible("", spec) == ""
    assert w.is_open("ta", spec) and w.is_open("tat", spec) is False and w.is_open("t", spec) is None
    assert w.is_open("tas'", spec) is True
    assert w.with_last_nucleus(["ta", "tes"], spec) == ["tates"]
    assert w.apertures(["ta", "tes"], spec) == [False, False] and w.apertures([], spec) == []


def test_command_line(capsys, tmp_path):
    assert main(["list"]) == 0 and "es" in capsys.readouterr().out
    assert main(["--json", "word", "es", "casa"]) == 0
    assert json.loads(capsys.readouterr().out)["ipa"] == e.own_engine("es").read("casa").ipa
    assert main([]) == 2 and main(["word"]) == 2
    assert main(["--json", "word", "qq", "x"]) == 1
    assert json.loads(capsys.readouterr().out)["type"] == "KeyError"
    bad = tmp_path / "x.json"
    bad.write_text("{}")
    assert main(["validate", str(bad)]) == 1


@pytest.mark.parametrize("args", [["info", "de"], ["transcribe", "fr", "bon jour"], ["word-candidates", "es", "queso", "2"], ["lattice", "es", "casa"], ["beam", "es", "casa", "3"], ["tokens", "es", "casa 1"], ["stress", "es", "casa"], ["tone", "o˧ŋ"], ["resolve", "pt-BR"], ["distance", "p", "b"]])
def test_commands_run(args, capsys):
    assert main(["--json", *args]) == 0
    assert json.loads(capsys.readouterr().out) is not None
