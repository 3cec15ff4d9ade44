"""The library's own small spelling tables for the languages of the documents, and synthetic families.

Every table is written for this library; readings are listed best first.
"""

from __future__ import annotations

from .inline import Inline

LANGUAGES = ("en", "de", "fr", "es")

#: Readings shared by all four languages, then what each adds or replaces.
_COMMON = {"a": "a", "b": "b", "d": "d", "f": "f", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "t": "t", "s": "s", "i": "i", "o": "o", "u": "u", "e": "e", "g": "ɡ", "q": "k", "r": "r", "x": "ks", "y": "i", "z": "z", "c": "k", "h": "h", "j": "j", "v": "v", "w": "w"}
_OWN = {
    "en": {"a": "æ ɑ eɪ", "c": "k s", "ch": "tʃ k", "ck": "k", "e": "ɛ iː", "ea": "iː ɛ", "ee": "iː", "g": "ɡ dʒ", "i": "ɪ aɪ", "ing": "ɪŋ", "j": "dʒ", "kn": "n", "ng": "ŋ", "o": "ɒ oʊ", "oo": "uː ʊ", "ou": "aʊ", "ow": "oʊ aʊ", "ph": "f", "qu": "kw", "r": "ɹ", "sh": "ʃ", "th": "θ ð", "tion": "ʃən", "u": "ʌ uː", "wh": "w", "y": "i j"},
    "de": {"a": "a aː", "ä": "ɛ ɛː", "au": "aʊ", "äu": "ɔʏ", "ch": "ç x", "chs": "ks", "ck": "k", "e": "ɛ eː ə", "ei": "aɪ", "eu": "ɔʏ", "i": "ɪ iː", "ie": "iː", "ng": "ŋ", "o": "ɔ oː", "ö": "œ øː", "pf": "pf", "qu": "kv", "r": "ʁ", "s": "s z", "sch": "ʃ", "ß": "s", "tz": "ts", "u": "ʊ uː", "ü": "ʏ yː", "v": "f v", "w": "v", "z": "ts"},
    "fr": {"ai": "ɛ", "an": "ɑ̃", "au": "o", "c": "k s", "ç": "s", "ch": "ʃ", "e": "ə ɛ", "eau": "o", "en": "ɑ̃", "eu": "ø œ", "é": "e", "è": "ɛ", "ê": "ɛ", "g": "ɡ ʒ", "gn": "ɲ", "h": "", "j": "ʒ", "oi": "wa", "on": "ɔ̃", "ou": "u", "ph": "f", "qu": "k", "r": "ʁ", "u": "y", "un": "œ̃"},
    "es": {"c": "k θ", "ch": "tʃ", "á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u", "g": "ɡ x", "gu": "ɡ", "h": "", "j": "x", "ll": "ʎ ʝ", "ñ": "ɲ", "qu": "k", "rr": "r", "r": "ɾ r", "v": "b", "z": "θ", "y": "ʝ i"},
}
#: Letters that a language's texts may borrow.
_BORROWED = {"ä": "ɛ", "ç": "s", "è": "ɛ", "é": "e", "ê": "ɛ", "í": "i", "ñ": "ɲ", "ó": "o", "ö": "ø", "ü": "y", "ß": "s"}


def spelling(lang: str) -> dict[str, list[str]]:
    """Grapheme to readings, best first; '' is a silent reading."""
    merged = {**_BORROWED, **_COMMON, **_OWN[lang]}
    return {g: v.split() or [""] for g, v in merged.items()}


def alternation(lang: str) -> str:
    """Maximal munch as a regular expression: longest graphemes first, then any character."""
    return "(" + "|".join(sorted(spelling(lang), key=lambda g: (-len(g), g))) + "|.)"


GRAPHEMES = Inline("graphemes", "lang string, grapheme string, rank int, ipa string", tuple((lang, g, k, ipa) for lang in LANGUAGES for g, v in sorted(spelling(lang).items()) for k, ipa in enumerate(v)))
WEIGHTS = Inline("weights", "grapheme string, rank int, ipa string, weight double", (("a", 0, "a", 0.1), ("a", 1, "b", 0.2), ("a", 2, "c", 0.3), ("e", 0, "e", 0.7), ("e", 1, "ɛ", 0.1), ("e", 2, "ə", 0.1), ("e", 3, "ɪ", 0.1), ("o", 0, "o", None), ("o", 1, "ɔ", None)))
LEXICON = Inline("lexicon", "lang string, word string, ipa string, priority int", (("en", "the", "ðə", 0), ("en", "of", "ɒv", 0), ("en", "is", "ɪz", 1), ("en", "is", "ɪs", 2), ("de", "der", "deːɐ̯", 0), ("de", "die", "diː", 0), ("fr", "de", "də", 0), ("fr", "les", "le", 0), ("es", "que", "ke", 0), ("es", "los", "los", 0)))
LEXICON_LINES = Inline("lexicon_lines", "line int, text string", ((1, "the\tðə"), (2, "of\tɒv"), (3, ""), (4, "the\tðiː"), (5, "broken"), (6, "a\tb\tc"), (7, "in\tɪn"), (8, "\tx"), (9, "of\tə")))
ENDINGS = Inline("endings", "lang string, ending string, ipa string", (("en", "ing", "ɪŋ"), ("en", "ting", "tɪŋ"), ("en", "ly", "li"), ("en", "tion", "ʃən"), ("en", "ed", "d"), ("en", "s", "z"), ("de", "ung", "ʊŋ"), ("de", "heit", "haɪt"), ("de", "keit", "kaɪt"), ("de", "en", "ən"), ("de", "lich", "lɪç"), ("fr", "ment", "mɑ̃"), ("fr", "tion", "sjɔ̃"), ("fr", "er", "e"), ("fr", "aux", "o"), ("es", "ción", "θjon"), ("es", "mente", "mente"), ("es", "ado", "aðo"), ("es", "os", "os")))
POSITIONAL = Inline("positional_rows", "lang string, grapheme string, position string, ipa string", (("en", "c", "before_front_vowel", "s"), ("en", "g", "before_front_vowel", "dʒ"), ("en", "y", "word_initial", "j"), ("en", "e", "word_final", ""), ("de", "s", "word_initial", "z"), ("de", "b", "word_final", "p"), ("de", "d", "word_final", "t"), ("de", "g", "word_final", "k"), ("fr", "c", "before_front_vowel", "s"), ("fr", "g", "before_front_vowel", "ʒ"), ("fr", "e", "word_final", ""), ("fr", "s", "intervocalic", "z"), ("fr", "t", "word_final", ""), ("es", "c", "before_front_vowel", "θ"), ("es", "g", "before_front_vowel", "x"), ("es", "r", "word_initial", "r")))
#: Order in which positions are tried, most specific first.
POSITION_ORDER = Inline("position_order", "position string, place int", tuple((p, k) for k, p in enumerate(("before_front_vowel", "word_initial", "word_final", "intervocalic", "default"))))
ALLOPHONE_RULES = Inline("allophone_rules", "lang string, place int, rule string, phoneme string, surface string, word_initial boolean, word_final boolean, after string, before string", (
    ("en", 1, "aspirate", "p", "pʰ", True, None, None, None), ("en", 2, "aspirate_t", "t", "tʰ", True, None, None, None), ("en", 3, "flap", "t", "ɾ", None, None, "vowel", "vowel"), ("en", 4, "dark_l", "l", "ɫ", None, True, None, None),
    ("de", 1, "ach", "ç", "x", None, None, "vowel", None), ("de", 2, "final_b", "b", "p", None, True, None, None), ("es", 1, "spirant_b", "b", "β", None, None, "vowel", None), ("es", 2, "spirant_d", "d", "ð", None, None, "vowel", None), ("es", 3, "spirant_g", "ɡ", "ɣ", None, None, "vowel", None), ("fr", 1, "final_r", "ʁ", "χ", None, True, None, None)))

# A synthetic family, with inheritance, clades and tombstones.
SPECS = Inline("specs", "code string, name string, parent string, clade boolean, script string, lat double, lon double, start_year int, end_year int", (
    ("zz-root", "Root", None, True, "Latin", None, None, None, None), ("zz-old", "Old", "zz-root", False, "Latin", 48.0, 2.0, 1000, 1500), ("zz-north", "North", "zz-old", False, "Latin", 55.0, 12.5, 1400, 1600), ("zz-south", "South", "zz-old", False, "Greek", 41.9, 12.5, 1400, 1900), ("zz-east", "East", "zz-branch", False, "Cyrillic", 55.75, 37.6, 1450, None), ("zz-branch", "Branch", "zz-old", True, "Latin", None, None, None, None), ("zz-west", "West", "zz-north", False, "Latin", 38.7, -9.1, 1700, 2000), ("zz-lost", "Lost", "zz-gone", False, "Arabic", 30.0, 31.2, 600, 900)))
SPEC_GRAPHEMES = Inline("spec_graphemes", "code string, grapheme string, rank int, ipa string", (
    ("zz-old", "a", 0, "a"), ("zz-old", "b", 0, "b"), ("zz-old", "c", 0, "k"), ("zz-old", "e", 0, "e"), ("zz-old", "p", 0, "p"), ("zz-old", "t", 0, "t"),
    ("zz-north", "c", 0, "s"), ("zz-north", "c", 1, "k"), ("zz-north", "d", 0, "d"), ("zz-north", "t", 0, None), ("zz-south", "a", 0, "a"), ("zz-south", "e", 0, "ɛ"), ("zz-south", "g", 0, "ɡ"), ("zz-east", "a", 0, "a"), ("zz-east", "ʃ", 0, "ʃ"), ("zz-east", "e", 0, "ə"), ("zz-west", "z", 0, "z"), ("zz-west", "b", 0, "v"), ("zz-lost", "m", 0, "m"), ("zz-lost", "n", 0, "n")))
SPEC_ALLOPHONES = Inline("spec_allophones", "code string, phoneme string, surface string", (("zz-old", "p", "p"), ("zz-old", "p", "pʰ"), ("zz-old", "b", "b"), ("zz-north", "p", "p"), ("zz-north", "s", "z"), ("zz-south", "a", "a"), ("zz-south", "ɡ", "ɣ"), ("zz-east", "a", "a"), ("zz-east", "ʃ", "ʒ"), ("zz-west", "b", "∅"), ("zz-lost", "m", "")))
SPEC_RULES = Inline("spec_rules", "code string, rule string, phoneme string", (("zz-old", "r1", "p"), ("zz-old", "r2", "x"), ("zz-north", "r3", "s"), ("zz-north", "r3", "ʒ"), ("zz-south", "r4", "θ"), ("zz-east", "r5", "ʃ"), ("zz-west", "r6", "q")))
SPEC_TONES = Inline("spec_tones", "code string, tone string", (("zz-old", "a"), ("zz-old", "b"), ("zz-north", "b"), ("zz-north", "c"), ("zz-east", "a")))
EDGES = Inline("edges", "code string, ancestor string, role string, weight double", (("zz-north", "zz-old", "parent", 0.8), ("zz-south", "zz-old", "parent", 0.9), ("zz-west", "zz-north", "parent", 0.7), ("zz-west", "zz-south", "substrate", 0.2), ("zz-east", "zz-old", "parent", 0.6), ("zz-west", "zz-old", "superstrate", 0.3)))
TAG_ALIASES = Inline("tag_aliases", "alias string, code string", (("iw", "he"), ("in", "id"), ("cmn", "zh"), ("eng", "en"), ("por", "pt"), ("sh", "sr-Latn")))
TAG_DEFAULTS = Inline("tag_defaults", "lang string, code string", (("en", "en-GB"), ("pt", "pt-PT"), ("zh", "zh-CN"), ("sr", "sr-Cyrl"), ("es", "es-ES")))
TAG_CATALOG = Inline("tag_catalog", "code string, place int", tuple((c, k) for k, c in enumerate(("en-GB", "en-US", "pt-PT", "pt-BR", "he", "id", "zh-CN", "sr-Cyrl", "sr-Latn", "es-ES", "es-MX", "fr-FR", "de-DE"))))
TAGS = Inline("tags", "tag string", tuple((t,) for t in ("en", "EN-us", "iw", "cmn", "pt-BR", "pt", "sr-Latn", "sh", "es-AR", "fr", "xx", "en-AU", "de-AT", "por")))

#: Scripts: type, direction, case, vowel marking, ancestors (fixed values, public knowledge of the writing systems).
_BRAHMIC = ("Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Gurmukhi", "Thai", "Tibetan")
SCRIPTS = Inline("scripts", "script string, kind string, direction string, has_case boolean, vowels int, ancestors array<string>", (
    ("Latin", "alphabet", "LTR", True, 0, ("Etruscan", "Greek", "Phoenician")), ("Cyrillic", "alphabet", "LTR", True, 0, ("Greek", "Phoenician")), ("Greek", "alphabet", "LTR", True, 0, ("Phoenician",)), ("Armenian", "alphabet", "LTR", True, 0, ("Greek", "Phoenician")), ("Georgian", "alphabet", "LTR", False, 0, ("Greek", "Phoenician")),
    ("Arabic", "abjad", "RTL", False, 1, ("Nabataean", "Aramaic", "Phoenician")), ("Hebrew", "abjad", "RTL", False, 1, ("Aramaic", "Phoenician")), *((s, "abugida", "LTR", False, 2, ("Brahmi",)) for s in _BRAHMIC), ("Ethiopic", "abugida", "LTR", False, 2, ("South Arabian",)),
    ("Hangul", "featural", "LTR", False, 0, ()), ("Hanzi", "logographic", "LTR", False, 3, ()), ("Kana", "syllabary", "LTR", False, 0, ()), ("Cherokee", "syllabary", "LTR", False, 0, ()), ("IPA-reconstruction", "reconstruction", "LTR", False, 0, ())))
