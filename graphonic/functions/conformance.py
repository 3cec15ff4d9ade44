"""Checks that a user's stage keeps the promises which training data rely on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from .engine import Engine, Spec
from .phones import segment_ipa

#: Words with hiatus, diphthongs, nasals, silent and accented letters, used where a caller gives none.
PROBES = ("poema", "viaje", "ciudad", "aéreo", "país", "guerra", "queso", "naïve", "maison", "château", "Straße", "über")


class ConformanceError(AssertionError):
    pass


def declared(spec: Spec) -> set[str]:
    """Every segment that a spec's tables can give."""
    readings = [r for values in spec.graphemes.values() for r in values]
    readings += [r for places in spec.positional.values() for values in places.values() for r in values]
    readings += [r for values in spec.endings.values() for r in values if r]
    readings += [rule.surface for rule in spec.rules] + list(spec.lexicon.values())
    return {s for r in readings for s in segment_ipa(r)} | {"ˈ", "ˌ"}


def _fail(rule: str, found: dict) -> None:
    if found:
        raise ConformanceError(f"{rule}: " + "; ".join(f"{w}: {x}" for w, x in sorted(found.items())))


def assert_rescorer_conforms(rescore: Callable, engine: Engine, words: Sequence[str] = ()) -> None:
    """The same answer from one engine and from a new one a word, with no segment that the spec does not declare."""
    words = list(words) or list(PROBES)
    held = replace(engine, rescore=rescore)
    first = {w: held.read(w, 1).ipa for w in words}
    again = {w: replace(engine, rescore=rescore).read(w, 1).ipa for w in words}
    _fail("two runs differ", {w: (first[w], again[w]) for w in words if first[w] != again[w]})
    known = declared(engine.spec)
    _fail("segments outside the inventory", {w: out for w in words if (out := [s for s in segment_ipa(first[w]) if s not in known])})


def assert_syllabifier_conforms(syllabify: Callable[[str, str], Sequence[str]], engine: Engine, words: Sequence[str] = (), codes: Sequence[str] | None = None) -> None:
    """It claims the language, its pieces join to the word, and transcription stays as it is without it."""
    words = list(words) or list(PROBES)
    if codes is not None and engine.spec.code not in codes:
        raise ConformanceError(f"no claim on {engine.spec.code}")
    pieces = {w: list(syllabify(w, engine.spec.code)) for w in words}
    _fail("pieces do not join to the word", {w: x for w, x in pieces.items() if "".join(x) != w})
    held = replace(engine, syllabify=syllabify)
    moved = {w: (a, b) for w in words if (a := engine.read(w, 1).ipa) != (b := held.read(w, 1).ipa)}
    _fail("the transcription changes", moved)
