"""Arabic script before tokenising: presentation forms and doubled consonants."""

from __future__ import annotations

import re
import unicodedata

#: Letters of the four Arabic blocks, vowel marks, and the mark of doubling, as classes that Java, Python and RE2 share (fixed values).
LETTER = "[\u0620-\u063f\u0641-\u064a\u066e-\u066f\u0671-\u06d3\u06d5\u06ee-\u06ef\u06fa-\u06fc\u06ff\u0750-\u077f\u0870-\u0887\u0889-\u088e\u08a0-\u08c8]"
VOWEL_MARK = "[\u064b-\u0650\u0652\u0670]"
DOUBLING = "\u0651"
#: What is replaced, in this order; groups are 1 the letter and 2 its vowel mark.
DOUBLED = ((f"({LETTER}){DOUBLING}({VOWEL_MARK})", 2), (f"({LETTER})({VOWEL_MARK}){DOUBLING}", 2), (f"({LETTER}){DOUBLING}", 1))
_FORMS = re.compile("[\ufb50-\ufdff\ufe70-\ufeff]")


def plain_forms(text: str) -> str:
    """Presentation forms as the letters that they show; everything else stays."""
    return _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)


def doubled(text: str) -> str:
    """A letter with the doubling mark twice, its vowel mark after the second."""
    for pattern, groups in DOUBLED:
        text = re.sub(pattern, r"\1\1\2" if groups == 2 else r"\1\1", text)
    return text
