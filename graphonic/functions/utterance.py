"""Kernels over utterances: markup, sandhi, tone, dialect transforms, lattice error rates, language tags."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from .phones import segment_distance, segment_ipa


class MarkupError(ValueError):
    pass


_PHONEME = re.compile(r'<phoneme((?:\s+[\w-]+\s*=\s*"[^"]*")*)\s*>(.*?)</phoneme>', re.S)
_PAIR = re.compile(r'([\w-]+)\s*=\s*"([^"]*)"')


def parse_markup(text: str) -> list[tuple[str, str | None]]:
    """(text, forced IPA or None) of each run; malformed phoneme tags are errors."""
    out, at = [], 0
    for m in _PHONEME.finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], None))
        given = dict(_PAIR.findall(m[1]))
        if given.get("alphabet") != "ipa":
            raise MarkupError("a phoneme needs alphabet=\"ipa\"")
        if not given.get("ph", "").strip():
            raise MarkupError("a phoneme needs a reading in ph")
        if not m[2].strip() or re.search(r"\s", m[2].strip()):
            raise MarkupError("a phoneme holds exactly one word")
        out.append((m[2].strip(), given["ph"].strip()))
        at = m.end()
    if at < len(text):
        out.append((text[at:], None))
    if any(re.search(r"</?phoneme\b", run) for run, ipa in out if ipa is None):
        raise MarkupError("a phoneme tag stands alone")
    return out


@dataclass(frozen=True)
class Sandhi:
    """A rule at the border of two words: contexts, and what either side becomes."""

    id: str
    left: str
    right: str
    transform: tuple[str, str] | None = None
    right_transform: tuple[str, str] | None = None
    obligatory: bool = True


def sandhi(words: Sequence[str], rules: Sequence[Sandhi], pausal: Sequence[bool] = (), obligatory_only: bool = False) -> list[str]:
    """A fold from left to right: each border sees what the border before it left; one rule for each side."""
    out = list(words)
    if pausal and len(pausal) != len(words):
        raise ValueError("one pausal flag for each word")
    for i in range(len(out) - 1):
        if pausal and pausal[i]:
            continue
        left, right = out[i], out[i + 1]
        done = [False, False]
        for r in rules:
            if obligatory_only and not r.obligatory or not (re.search(r.left, left) and re.search(r.right, right)):
                continue
            for side, change in enumerate((r.transform, r.right_transform)):
                if change and not done[side]:
                    out[i + side] = re.sub(change[0], change[1], (left, right)[side])
                    done[side] = True
    return out


#: French liaison and elision in the library's own rules.
LIAISON = (Sandhi("liaison_z", r"le$", r"^[aɑeɛiouyøœə]", (r"$", "z")), Sandhi("elision", r"də$", r"^[aɑeɛiouyøœ]", (r"ə$", "")))


def tone_of(kind: str, shape: str, mark: str, table: dict[tuple[str, str, str], str]) -> str | None:
    """Most specific first: exact shape, then any."""
    return table.get((kind, shape, mark)) or table.get((kind, "any", mark))


#: Profiles: chain shifts (one pass, single letters) and plain rules with a context.
PROFILES: dict[str, dict] = {
    "lisbon": {"chain": {}, "plain": ((r"l(?=[^aeiouɐɛɔəɨ]|$)|(?<=ə)l", "ɫ"),)},
    "chain": {"chain": {"e": "i", "i": "ɨ", "o": "u"}, "plain": ()},
    "betacism": {"chain": {}, "plain": ((r"v", "b"),)},
}


def dialect(ipa: str, profile: str) -> str:
    if profile not in PROFILES:
        raise KeyError(f"unknown profile: {profile}")
    p = PROFILES[profile]
    out = ipa.translate(str.maketrans(p["chain"]))
    for a, b in p["plain"]:
        out = re.sub(a, b, out)
    return out


def lattice_per(slots: Sequence[Sequence[str]], final: str, reference: str, weighted: bool = False) -> float:
    """The smallest edit distance of any path or the final reading to the reference, by its segments."""
    ref = [s for part in reference.split() for s in segment_ipa(part.strip("ˈˌ.‿|‖"))]
    cost = segment_distance if weighted else lambda a, b: float(a != b)

    def fold(row: list[float], segments: list[str]) -> list[float]:
        for s in segments:
            new = [row[0] + 1]
            for j, r in enumerate(ref, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + cost(s, r)))
            row = new
        return row

    start = [float(j) for j in range(len(ref) + 1)]
    row = start
    for slot in slots:
        ends = [fold(row, segment_ipa(c)) for c in slot]
        if ends:
            row = [min(x) for x in zip(*ends)]
    return min(row[-1], fold(start, segment_ipa(final))[-1]) / max(len(ref), 1)


class LanguageTagError(ValueError):
    pass


_KINDS = ("extlang", "script", "territory", "variant", "extension", "private")


def parse_tag(tag: str) -> list[tuple[str, str]]:
    """(kind, value) of each subtag of a BCP 47 tag, in canonical case."""
    parts = tag.replace("_", "-").split("-")
    if not parts[0].isalpha() or not 2 <= len(parts[0]) <= 8 and parts[0].lower() not in ("x", "i"):
        raise LanguageTagError(f"not a language: {tag!r}")
    out, order, k = [("language", parts[0].lower())], -1, 1
    if parts[0].lower() == "x":
        return [("private", "-".join(parts).lower())]
    while k < len(parts):
        p = parts[k]
        if not p or not p.isalnum():
            raise LanguageTagError(f"bad subtag in {tag!r}")
        if len(p) == 1:
            end = len(parts) if p.lower() == "x" else next((i for i in range(k + 1, len(parts)) if len(parts[i]) == 1), len(parts))
            if end == k + 1:
                raise LanguageTagError(f"empty extension in {tag!r}")
            out.append(("private" if p.lower() == "x" else "extension", "-".join(parts[k:end]).lower()))
            k = end
            continue
        kind = "territory" if len(p) == 2 or len(p) == 3 and p.isdigit() else "extlang" if len(p) == 3 else "script" if len(p) == 4 and p.isalpha() else "variant"
        place = _KINDS.index(kind)
        if place < order or place == order and kind in ("script", "territory"):
            raise LanguageTagError(f"subtags out of order in {tag!r}")
        order = place
        out.append((kind, p.upper() if kind == "territory" else p.title() if kind == "script" else p.lower()))
        k += 1
    return out


def to_tag(parts: Sequence[tuple[str, str]]) -> str:
    return "-".join(v for _, v in parts)
