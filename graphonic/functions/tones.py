"""Tones computed from spelling: onset class, shape of the rime, written mark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from .phones import is_vowel, segment_ipa


@dataclass(frozen=True)
class ToneSystem:
    """Classes of consonant letters, written marks, the table (class, shape, mark) to tone, and the tones' letters."""

    classes: Mapping[str, str]
    marks: Mapping[str, str]
    table: Mapping[tuple[str, str, str], str]
    letters: Mapping[str, str]
    dead_codas: tuple[str, ...] = ()
    no_mark: str = "none"
    atoms: tuple[str, ...] = ()


def shape(ipa: str, system: ToneSystem) -> str | None:
    """live, dead_long or dead_short; None without a vowel.  An open syllable is dead if its vowel is short."""
    segments = segment_ipa(ipa, system.atoms)
    first = next((k for k, s in enumerate(segments) if is_vowel(s[:1])), None)
    if first is None:
        return None
    last = next((k for k in range(first, len(segments)) if not is_vowel(segments[k][:1])), len(segments))
    long, coda = "ː" in "".join(segments[first:last]), "".join(segments[last:])
    dead = coda.startswith(system.dead_codas) if coda else not long
    return ("dead_long" if long else "dead_short") if dead else "live"


def tone(graphemes: Sequence[str], ipa: str, system: ToneSystem) -> str:
    """The tone letter of one syllable: its own shape in the table before 'any'; empty if nothing fits."""
    letters = "".join(graphemes)
    kind = next((system.classes[c] for c in letters if c in system.classes), None)
    mark = next((system.marks[c] for c in reversed(letters) if c in system.marks), system.no_mark)
    form = shape(ipa, system)
    if kind is None or form is None:
        return ""
    name = next((system.table[k] for k in ((kind, form, mark), (kind, "any", mark)) if k in system.table), "")
    return system.letters.get(name, "")


def slots_by_syllable(segments: Sequence[str]) -> list[list[int]]:
    """Slots grouped by nucleus: a slot that begins with its own consonant opens a syllable, else the last sounding slot before the vowel does."""
    nuclei = [k for k, s in enumerate(segments) if any(map(is_vowel, s))]
    starts = [0] * bool(nuclei)
    for before, k in zip(nuclei, nuclei[1:]):
        own = not is_vowel(segments[k][0])
        starts.append(k if own else max((j for j in range(before + 1, k) if segments[j]), default=k))
    return [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(segments)])]


def with_tones(graphemes: Sequence[str], segments: Sequence[str], system: ToneSystem) -> str:
    """The reading with each syllable's tone letter at its end; a reading without a vowel stays."""
    groups = slots_by_syllable(segments)
    if not groups:
        return "".join(segments)
    out = ""
    for slots in groups:
        ipa = "".join(segments[k] for k in slots)
        out += ipa + tone([graphemes[k] for k in slots if k < len(graphemes)], ipa, system)
    return out
