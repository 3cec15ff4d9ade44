"""What is silent at the end of a word, and whether a written syllable is open."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from unicodedata import combining

from .engine import VOWEL_LETTERS, Spec, Token

#: Letters that a silent ending may be followed by, and a digraph that counts as one consonant (fixed values).
TRANSPARENT, MUTE_E_ENDINGS, MUTE_E_DIGRAPHS = ("s", "x"), ("s", "d"), ("th",)
#: The longest silent ending looked for.
TAIL = 3


@dataclass(frozen=True)
class WordEnd:
    """Whether a slot is the last, the last audible one, and a vowel that may be silent there."""

    final: bool = False
    last_audible: bool = False
    silent_vowel: bool = False


def _may_be_silent(g: str, spec: Spec) -> bool:
    return "" in spec.positional.get(g, {}).get("word_final", ())


def _vowel(g: str) -> bool:
    return g[:1] in VOWEL_LETTERS and bool(g)


def word_end(tokens: Sequence[Token], k: int, spec: Spec) -> WordEnd:
    """By what the spec declares silent word-finally only."""
    after = [t.grapheme for t in tokens[k + 1 : k + 3]]
    final = not after
    audible = len(after) == 1 and after[0] in TRANSPARENT and _may_be_silent(after[0], spec)
    g = tokens[k].grapheme
    return WordEnd(final, audible, (final or audible) and _vowel(g) and _may_be_silent(g, spec))


def is_mute_e(tokens: Sequence[Token], k: int) -> bool:
    """A last e, or one before an ending, after one consonant that follows a vowel."""
    g = [t.grapheme for t in tokens]
    tail = g[k + 1 :]
    if g[k] != "e" or k < 2 or tail and (len(tail) > 1 or tail[0] not in MUTE_E_ENDINGS):
        return False
    single = len(g[k - 1]) == 1 or g[k - 1] in MUTE_E_DIGRAPHS
    return single and not _vowel(g[k - 1]) and _vowel(g[k - 2])


def silent_finally(letters: str, spec: Spec) -> bool:
    """Whether the first reading that holds at the end of a word is empty."""
    places = spec.positional.get(letters, {})
    reading = places.get("word_final") or places.get("default") or spec.graphemes.get(letters)
    return bool(reading) and reading[0] == ""


def audible(syllable: str, spec: Spec) -> str:
    """A syllable without its silent endings, longest first."""
    while n := next((n for n in range(min(TAIL, len(syllable)), 0, -1) if silent_finally(syllable[-n:].lower(), spec)), 0):
        syllable = syllable[:-n]
    return syllable


def _letters(syllable: str) -> str:
    while syllable and not (syllable[-1].isalpha() or combining(syllable[-1])):
        syllable = syllable[:-1]
    return syllable


def _has_vowel(syllable: str) -> bool:
    return any(c in VOWEL_LETTERS for c in syllable.lower())


def is_open(syllable: str, spec: Spec, last: bool = False) -> bool | None:
    """Whether a written syllable ends in its vowel; None without one.  A hyphen or apostrophe ends the word."""
    core = _letters(syllable)
    if last or core != syllable:
        core = audible(core, spec)
    return core[-1].lower() in VOWEL_LETTERS if _has_vowel(core) else None


def with_last_nucleus(syllables: Sequence[str], spec: Spec) -> list[str]:
    """A last syllable in which no vowel sounds joins the one before."""
    out = list(syllables)
    if len(out) > 1 and not _has_vowel(audible(_letters(out[-1]), spec)):
        out[-2:] = ["".join(out[-2:])]
    return out


def apertures(syllables: Sequence[str], spec: Spec) -> list[bool | None]:
    """is_open of each written syllable; those of a joined last syllable share their answer."""
    joined = with_last_nucleus(syllables, spec)
    found = [is_open(s, spec, k == len(joined) - 1) for k, s in enumerate(joined)]
    return [found[min(k, len(found) - 1)] for k in range(len(syllables))]
