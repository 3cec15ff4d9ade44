"""Syllables of transcriptions and spellings: nuclei, onsets, length and stress marks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from itertools import groupby

from .engine import VOWEL_LETTERS, weight
from .phones import AT, is_vowel, segment_ipa, vector

LONG, PRIMARY, SECONDARY = "ː", "ˈ", "ˌ"
LIQUIDS, GLIDES = frozenset("lrɾɹʁʀʎɫ"), frozenset("jwɥɰ")


def _rides(c: str) -> bool:
    """Whether a character belongs to what stands before it."""
    return unicodedata.combining(c) != 0 or c in "ːˑ"


def syllabify_ipa(ipa: str, max_onset: int = 1, atoms: tuple[str, ...] = ()) -> list[str]:
    """A run of vowels is a nucleus; at most ``max_onset`` segments before it open its syllable.

    Without a vowel the whole is one syllable; an empty reading has none.
    """
    runs = [(vowel, list(part)) for vowel, part in groupby(segment_ipa(ipa, atoms), lambda s: is_vowel(s[:1]))]
    out, onset = [], ""
    for k, (vowel, part) in enumerate(runs):
        if vowel:
            out.append(onset + "".join(part))
            onset = ""
        elif not out:
            onset = "".join(part)
        else:
            cut = len(part) if k == len(runs) - 1 else max(len(part) - max_onset, 0)
            out[-1] += "".join(part[:cut])
            onset = "".join(part[cut:])
    return out or ([ipa] if ipa else [])


def iambic_positions(syllables: Sequence[str], atoms: tuple[str, ...] = ()) -> list[int]:
    """Light syllables that close a foot, in words of three and more; the last never lengthens."""
    if len(syllables) < 3:
        return []
    light = [weight(segment_ipa(s, atoms)) == "light" for s in syllables]
    return [k for k in range(int(light[0]), len(light) - 1, 2) if light[k]]


def iambic_length(ipa: str, max_onset: int = 1, atoms: tuple[str, ...] = ()) -> str:
    """Length on the first vowel of each such syllable; a reading that has length already stays."""
    if LONG in ipa:
        return ipa
    syllables = syllabify_ipa(ipa, max_onset, atoms)
    for k in iambic_positions(syllables, atoms):
        segments = segment_ipa(syllables[k], atoms)
        at = next(i for i, s in enumerate(segments) if is_vowel(s[:1]))
        segments[at] += LONG
        syllables[k] = "".join(segments)
    return "".join(syllables)


def split_nuclei(run: str, diphthongs: Collection[str], hiatus: Collection[int] = ()) -> list[str]:
    """A run of vowels cut into nuclei: the longest declared diphthong that no hiatus cuts, else one vowel; marks ride along."""
    low, out, at = run.lower(), [], 0
    longest = sorted(diphthongs, key=len, reverse=True)
    while at < len(run):
        end = at + next((len(d) for d in longest if low.startswith(d, at) and not any(at < h < at + len(d) for h in hiatus)), 1)
        while end < len(run) and _rides(run[end]):
            end += 1
        out.append(run[at:end])
        at = end
    return out


@dataclass(frozen=True)
class ClosedHiatus:
    """Pairs of vowels that stand apart before one of the onsets, or before a coda letter that no vowel follows."""

    pairs: frozenset[str]
    codas: frozenset[str] = frozenset()
    onsets: tuple[str, ...] = ()


@dataclass(frozen=True)
class FinalDiphthongs:
    """Diphthongs that stand apart from a vowel before them at the end of a word, bare or before one of the finals."""

    diphthongs: tuple[str, ...]
    finals: tuple[str, ...] = ()


def hiatus_candidates(word: str, closed: ClosedHiatus | None = None, final: FinalDiphthongs | None = None, graphemes: Collection[str] = ()) -> set[int]:
    """Places at which vowels may stand apart; a coda letter that begins a longer grapheme is none."""
    low = word.lower()
    vowel = lambda c: c != "" and c in VOWEL_LETTERS
    found = set()
    if closed:
        longer = tuple(g for g in graphemes if len(g) > 1)
        for k in (k for k in range(1, len(low)) if low[k - 1 : k + 1] in closed.pairs):
            rest = low[k + 1 :]
            coda = rest[:1] in closed.codas and not vowel(rest[1:2]) and not rest.startswith(longer)
            if rest.startswith(closed.onsets) or coda:
                found.add(k)
    if final:
        tails = [d + f for d in final.diphthongs for f in ("", *final.finals)]
        found |= {len(low) - len(x) for x in tails if len(low) > len(x) and low.endswith(x) and vowel(low[-len(x) - 1])}
    return found


def hiatus_places(word: str, divide: Callable[[str, set[int]], Sequence[str]], stress: Callable[[Sequence[str]], int], candidates: set[int]) -> set[int]:
    """The candidates at which, with all of them cut, the stressed syllable begins."""
    if not candidates:
        return set()
    parts = divide(word, candidates)
    return candidates & {sum(map(len, parts[: stress(parts)]))}


def syllabify(word: str, nucleus: Callable[[str], bool], diphthongs: Collection[str] = (), hiatus: Collection[int] = ()) -> list[str]:
    """Every nucleus with all consonants before it; what follows the last nucleus closes its syllable.

    ``hiatus`` are places in the word at which a diphthong must not be read.
    """
    out, onset, at = [], "", 0
    while at < len(word):
        end = at + 1
        if not nucleus(word[at]):
            onset += word[at]
            at = end
            continue
        while end < len(word) and (nucleus(word[end]) or _rides(word[end])):
            end += 1
        first, *rest = split_nuclei(word[at:end], diphthongs, [h - at for h in hiatus if at < h < end])
        out += [onset + first, *rest]
        onset, at = "", end
    if onset:
        out[-1:] = [out[-1] + onset] if out else [onset]
    return out


def sonority(segment: str) -> int:
    """From 1 (stops) over fricatives, nasals and liquids to 5 (glides); 0 where the phone is unknown."""
    v = vector(segment) or vector(segment[:1])
    if v is None:
        return 0
    if not v[AT["consonantal"]]:
        return 5
    if v[AT["nasal"]]:
        return 3
    if v[AT["sonorant"]]:
        return 4 if segment[:1] != "h" else 2
    return 2 if v[AT["continuant"]] else 1


def legal_onset(cluster: Sequence[str], clusters: Collection[str] = (), most: int | None = None) -> bool:
    """Declared, or single, or rising in sonority, or s before a stop that opens a legal onset; within the cap."""
    if most is not None and len(cluster) > most:
        return False
    if len(cluster) < 2 or "".join(cluster) in clusters:
        return True
    if cluster[0] == "s" and sonority(cluster[1]) == 1:
        return legal_onset(cluster[1:], clusters)
    steps = [sonority(s) for s in cluster]
    return all(a < b - 1 or a < b and a < 3 <= b for a, b in zip(steps, steps[1:]))


def rebalance(syllables: Sequence[str], clusters: Collection[str] = (), most: int | None = None, atoms: tuple[str, ...] = ()) -> list[str]:
    """Move the head of an onset that is not legal to the syllable before."""
    out = list(syllables[:1])
    for s in syllables[1:]:
        segments = segment_ipa(s, atoms)
        n = next((k for k, x in enumerate(segments) if is_vowel(x[:1])), 0)
        cut = next(k for k in range(n + 1) if legal_onset(segments[k:n], clusters, most))
        out[-1] += "".join(segments[:cut])
        out.append("".join(segments[cut:]))
    return out


def capture_liquids(syllables: Sequence[str]) -> list[str]:
    """A liquid before another consonant that is no glide closes the syllable before."""
    out = list(syllables[:1])
    for s in syllables[1:]:
        segments = segment_ipa(s)
        n = next((k for k, x in enumerate(segments) if is_vowel(x[:1])), len(segments))
        k = int(n >= 2 and bool(out[-1]) and segments[0][:1] in LIQUIDS and segments[1][:1] not in GLIDES)
        out[-1] += "".join(segments[:k])
        out.append("".join(segments[k:]))
    return out


def fold_inserted(syllables: Sequence[str], inserted: Collection[int]) -> list[str]:
    """Join a syllable all of whose vowels (places in the reading) are inserted to the one before."""
    out, at = [], 0
    for s in syllables:
        vowels = [at + k for k, c in enumerate(s) if is_vowel(c)]
        if out and vowels and set(vowels) <= set(inserted):
            out[-1] += s
        else:
            out.append(s)
        at += len(s)
    return out


def _marked(syllable: str, mark: str) -> str:
    at = next((k for k, c in enumerate(syllable) if not _rides(c)), len(syllable))
    return syllable[:at] + mark + syllable[at:]


def _schwa_only(syllable: str, last: bool) -> bool:
    """Whether a syllable's one vowel is a schwa; a last syllable that ends in it is a written one."""
    return [c for c in syllable if is_vowel(c)] == ["ə"] and not (last and syllable.endswith("ə"))


def stress_mark(ipa: str, index: int, syllables: Sequence[str], written: int | None = None, secondary: Collection[int] = (), mark: str = PRIMARY) -> str:
    """Mark the stressed and the secondary syllables of a reading; a marked reading stays as it is.

    Indices count the ``written`` syllables (as many as are spoken, if not given), negative ones from the end.
    Spoken syllables in excess that hold a schwa only join the ones before them first; places are counted from the end.
    """
    if mark in ipa or PRIMARY in ipa or not syllables:
        return ipa
    spoken, n = list(syllables), len(syllables) if written is None else written
    if index >= 0 and len(spoken) > n:
        over, joined = len(spoken) - n, spoken[:1]
        for k, s in enumerate(spoken[1:], 1):
            if over and _schwa_only(s, k == len(spoken) - 1):
                joined[-1] += s
                over -= 1
            else:
                joined.append(s)
        spoken = joined
    place = lambda k: max(len(spoken) - (-k if k < 0 else max(n - k, 1)), 0)
    marks = {place(k): SECONDARY for k in secondary} | {place(index): mark}
    return "".join(_marked(s, marks[k]) if k in marks else s for k, s in enumerate(spoken))


def syllables_for(word: str, lang: str, own: Callable[[str], list[str]], plugin: Callable[[str, str], Sequence[str]] | None = None) -> list[str]:
    """A caller's syllabifier, if it gives pieces that join to the word; else the library's own."""
    if plugin is not None:
        try:
            given = list(plugin(word, lang))
            if given and "".join(given) == word:
                return given
        except Exception:  # a user's stage: any failure means the library's own answer
            pass
    return own(word)
