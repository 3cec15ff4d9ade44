"""The word kernel: spelling to ranked readings, without Spark.

Normalise, tokenise by maximal munch, choose readings by position, search a
beam, rewrite by allophone rules, apply endings, place stress.  Objects are
immutable once built, so one engine a worker serves all its rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from .phones import is_vowel, segment_ipa

FRONT = frozenset("eiéèêíëïyäöü")
VOWEL_LETTERS = frozenset("aeiouyáéíóúàèìòùâêîôûäëïöüãõæœø")
FLOOR = 1e-6
#: The combining nasal mark.
NASAL = "\u0303"


@dataclass(frozen=True)
class Token:
    kind: str
    grapheme: str
    ipa: tuple[str, ...]
    position: int
    length: int


@dataclass(frozen=True)
class Candidate:
    ipa: str
    cost: float


@dataclass(frozen=True)
class Rule:
    """One allophone rule; None means no condition."""

    id: str
    phoneme: str
    surface: str
    word_initial: bool | None = None
    word_final: bool | None = None
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class Abugida:
    """How consonant letters get their vowels: the inherent vowel and signs beyond the combining ones."""

    inherent: str
    final: str | None = None
    dependent: frozenset[str] = frozenset()
    preposed: frozenset[str] = frozenset()
    #: Whether a consonant after a vowel closes its syllable instead of opening one.
    bare_codas: bool = False


@dataclass(frozen=True)
class Spec:
    """What the kernel knows of a language."""

    code: str
    graphemes: Mapping[str, Sequence[str]]
    weights: Mapping[str, Sequence[float]] = field(default_factory=dict)
    positional: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    rules: Sequence[Rule] = ()
    endings: Mapping[str, Sequence[str | None]] = field(default_factory=dict)
    lexicon: Mapping[str, str] = field(default_factory=dict)
    stress: str = "penult"
    clitics: frozenset[str] = frozenset()
    abugida: Abugida | None = None
    #: Graphemes whose last letter goes to the next syllable before a vowel letter.
    glide_backoff: frozenset[str] = frozenset()

    @cached_property
    def by_length(self) -> list[int]:
        return sorted({len(g) for g in self.graphemes}, reverse=True)


def lower(text: str, lang: str = "") -> str:
    """Full lower case; Turkish letters by language."""
    if lang.split("-")[0] in ("tr", "az"):
        text = text.replace("I", "ı").replace("İ", "i")
    return text.lower()


def kind_of(c: str) -> str:
    if c.isspace():
        return "WHITESPACE"
    if c.isdigit():
        return "DIGIT"
    if unicodedata.category(c)[0] in "PS":
        return "PUNCTUATION"
    return "UNKNOWN"


def _taken(low: str, at: int, n: int, spec: Spec, before: Sequence[Token]) -> int:
    """How many letters of a grapheme stay together.

    A listed grapheme gives up its last letter before a vowel letter.  One in -u or -i after a consonant letter gives it
    up where its reading has no vowel and none follows, and where it is read as a glide between a vowel and a back vowel
    with which the letter has a grapheme of its own.
    """
    key, after = low[at : at + n], low[at + n : at + n + 1]
    if n < 2 or key[:-1] not in spec.graphemes or key[-1] not in spec.graphemes:
        return n
    vowel_follows = bool(after) and after in VOWEL_LETTERS
    if key in spec.glide_backoff and vowel_follows:
        return n - 1
    if key[-1] not in "ui" or key[0] in VOWEL_LETTERS:
        return n
    places = spec.positional.get(key, {})
    if not vowel_follows:
        reading = places.get("before_consonant" if after else "word_final")
        if reading is None:
            reading = places.get("default") or spec.graphemes[key]
        return n if any(map(is_vowel, reading[0] if reading else "")) else n - 1
    glide = (places.get("before_a") or places.get("before_back_vowel") or ("",))[0]
    last = next((t.ipa[0] for t in reversed(before) if t.kind == "GRAPHEME" and t.ipa), "")
    between = after not in FRONT and bool(last) and is_vowel(last[-1])
    return n - 1 if between and set(glide) & set("wj") and key[-1] + after in spec.graphemes else n


def tokenize(text: str, spec: Spec) -> list[Token]:
    """Longest graphemes first; what no grapheme claims is a token of one character."""
    text = unicodedata.normalize("NFC", text)
    folded = [lower(c, spec.code) for c in text]
    folded = [f if len(f) == 1 else c for f, c in zip(folded, text)]
    low, out, at = "".join(folded), [], 0
    while at < len(text):
        for n in spec.by_length:
            found = spec.graphemes.get(low[at : at + n])
            if found is not None and at + n <= len(text):
                n = _taken(low, at, n, spec, out) if n > 1 else n
                out.append(Token("GRAPHEME", low[at : at + n], tuple(spec.graphemes[low[at : at + n]]), at, n))
                at += n
                break
        else:
            bare = unicodedata.normalize("NFD", low[at])[0]
            if bare != low[at] and bare in spec.graphemes:
                out.append(Token("GRAPHEME", bare, tuple(spec.graphemes[bare]), at, 1))
            else:
                out.append(Token(kind_of(text[at]), text[at], (), at, 1))
            at += 1
    return with_vowels(out, spec.abugida) if spec.abugida else out


def _vowel_first(t: Token) -> bool:
    return bool(t.ipa and t.ipa[0]) and is_vowel(t.ipa[0][0])


def _sounds_consonant(t: Token, a: Abugida) -> bool:
    return t.kind == "GRAPHEME" and bool(t.ipa and t.ipa[0]) and not _vowel_first(t) and t.grapheme not in a.dependent | a.preposed


def _is_sign(t: Token, a: Abugida) -> bool:
    """Whether a token writes the vowel of the consonant before it."""
    return t.kind == "GRAPHEME" and _vowel_first(t) and (t.grapheme in a.dependent or unicodedata.category(t.grapheme[0]) in ("Mn", "Mc"))


def with_vowels(tokens: Sequence[Token], a: Abugida) -> list[Token]:
    """Give consonant tokens their vowels.

    A virama joins its consonant and silences the inherent vowel; a sign replaces it; a vowel written before a consonant
    is read after it, or, where a sign follows too, only by that sign.
    """
    out: list[Token] = []
    nucleus = False  # whether the syllable so far has its vowel
    k = 0
    while k < len(tokens):
        t = tokens[k]
        after = tokens[k + 1] if k + 1 < len(tokens) else None
        if t.grapheme in a.preposed and after and _sounds_consonant(after, a):
            tail = k + 2 < len(tokens) and _is_sign(tokens[k + 2], a)
            out += [replace(t, ipa=()), after if tail else replace(after, ipa=tuple(c + v for c in after.ipa for v in t.ipa))]
            nucleus = not tail
            k += 2
        elif not _sounds_consonant(t, a):
            out.append(t)
            nucleus = t.kind == "GRAPHEME" and (_vowel_first(t) or nucleus and not any(t.ipa))
            k += 1
        elif after and len(after.grapheme) == 1 and unicodedata.combining(after.grapheme) == 9:
            out.append(replace(t, grapheme=t.grapheme + after.grapheme, length=t.length + after.length))
            nucleus = False
            k += 2
        else:
            last = after is None or after.kind != "GRAPHEME"
            if not (after and _is_sign(after, a)) and not (a.bare_codas and nucleus):
                vowel = a.final if last and a.final is not None and nucleus else a.inherent
                t = replace(t, ipa=tuple(x + vowel for x in t.ipa))
                nucleus = bool(vowel)
            else:
                nucleus = False
            out.append(t)
            k += 1
    return out


def base_costs(ipa: Sequence[str], weights: Sequence[float | None] = ()) -> list[float]:
    """Rank, or minus the log of the share of the weight where all weights are given."""
    if len(weights) != len(ipa) or any(w is None or not math.isfinite(w) or w < 0 for w in weights) or not (total := sum(map(float, weights))):
        return [float(k) for k in range(len(ipa))]
    return [-math.log(max(w / total, FLOOR)) for w in weights]


def positions(tokens: Sequence[Token], k: int) -> list[str]:
    """Keys of a slot's surroundings, most specific first."""
    prev, next_ = (tokens[k - 1].grapheme if k else None), (tokens[k + 1].grapheme if k + 1 < len(tokens) else None)
    vowel = lambda g: g is not None and g[:1] in VOWEL_LETTERS
    out = []
    if next_ and next_[0] in FRONT:
        out.append("before_front_vowel")
    if prev is None:
        out.append("word_initial")
    if next_ is None:
        out.append("word_final")
    if prev and next_ and prev[-1:] in VOWEL_LETTERS and vowel(next_):
        out.append("intervocalic")
    if prev and prev[-1:] in VOWEL_LETTERS:
        out.append("after_vowel")
    elif prev:
        out.append("after_consonant")
    if next_:
        out.append("before_vowel" if vowel(next_) else "before_consonant")
    return [*out, "default"]


def branches(tokens: Sequence[Token], k: int, spec: Spec) -> list[Candidate]:
    """A slot's readings: the first declared position's, then flat ones not among them."""
    t = tokens[k]
    declared = spec.positional.get(t.grapheme, {})
    first = next((list(declared[p]) for p in positions(tokens, k) if p in declared), [])
    flat = [x for x in t.ipa if x not in first]
    costs = base_costs(t.ipa, spec.weights.get(t.grapheme, ())) if not first else [float(i) for i in range(len(first) + len(flat))]
    best: dict[str, float] = {}
    for ipa, cost in zip([*first, *flat], costs):
        best[ipa] = min(cost, best.get(ipa, math.inf))
    return sorted((Candidate(i, c) for i, c in best.items()), key=lambda x: (x.cost, x.ipa))


def carries(ipa: str) -> bool:
    """Whether a reading ends in a vowel or glide, marks aside, on which a nasal mark can be written."""
    at = _mark_place(ipa)
    return at > 0 and (ipa[at - 1] in "wjɥɰ" or is_vowel(ipa[at - 1]))


def _mark_place(ipa: str) -> int:
    """Where a nasal mark goes: after the last letter, before its length and other marks."""
    at = len(ipa)
    while at and (ipa[at - 1] in "ːˑ" or ipa[at - 1] != NASAL and unicodedata.combining(ipa[at - 1])):
        at -= 1
    return at


def _extended(path: tuple[str, ...], ipa: str) -> tuple[str, ...] | None:
    """A path with one more reading; a bare nasal mark goes onto the last sounding one, None if that cannot carry it."""
    if ipa != NASAL:
        return (*path, ipa)
    at = next((k for k in range(len(path) - 1, -1, -1) if path[k]), None)
    if at is None or not carries(path[at]):
        return None
    held, place = path[at], _mark_place(path[at])
    return (*path[:at], held[:place] + NASAL + held[place:], *path[at + 1 :], "")


def nasal_carriers(slots: Sequence[Sequence[Candidate]]) -> list[list[Candidate]]:
    """Before a slot that is a nasal mark alone, keep the readings that can carry it; silent ones pass the demand on."""
    out = [list(s) for s in slots]
    for k in range(1, len(out)):
        if not out[k] or out[k][0].ipa != NASAL or any(c.ipa != NASAL for c in out[k]):
            continue
        for j in range(k - 1, -1, -1):
            silent = any(not c.ipa for c in out[j])
            out[j] = [c for c in out[j] if not c.ipa or carries(c.ipa)] or out[j]
            if not silent:
                break
    return out


def beam(slots: Sequence[Sequence[Candidate]], width: int = 8) -> list[tuple[float, tuple[str, ...]]]:
    """The cheapest paths through the slots; ties keep the order in which they were made, then by spelling at the end."""
    paths: list[tuple[float, tuple[str, ...]]] = [(0.0, ())]
    for slot in slots:
        if slot:
            made = []
            if any(c.ipa == NASAL for c in slot):
                made = [(s + c.cost, q) for s, p in paths for c in slot if (q := _extended(p, c.ipa))]
            paths = sorted(made or [(s + c.cost, (*p, c.ipa)) for s, p in paths for c in slot], key=lambda x: x[0])[:width]
    return sorted(paths, key=lambda x: (x[0], "".join(x[1])))


def in_class(segment: str | None, name: str | None) -> bool:
    if name is None:
        return True
    if segment is None:
        return name == "boundary"
    vowel = is_vowel(segment[:1])
    return {"vowel": vowel, "consonant": not vowel}.get(name, segment == name)


def rewrite(path: Sequence[str], rules: Sequence[Rule]) -> list[str]:
    """The first rule that fits a segment rewrites it; neighbours are read as they were."""
    held = [s for part in path for s in segment_ipa(part)]
    out = []
    for k, s in enumerate(held):
        prev, next_ = (held[k - 1] if k else None), (held[k + 1] if k + 1 < len(held) else None)
        out.append(next((r.surface for r in rules if r.phoneme == s and r.word_initial in (None, prev is None) and r.word_final in (None, next_ is None) and in_class(prev, r.after) and in_class(next_, r.before)), s))
    return out


def syllables(ipa: Sequence[str]) -> list[list[str]]:
    """Segments grouped by nucleus; one consonant before a nucleus opens its syllable."""
    nuclei = [k for k, s in enumerate(ipa) if is_vowel(s[:1])]
    nuclei = [k for i, k in enumerate(nuclei) if not i or nuclei[i - 1] != k - 1]
    if not nuclei:
        return [list(ipa)] if ipa else []
    cuts = [0]
    for a, b in zip(nuclei, nuclei[1:]):
        cuts.append(b - 1 if b - 1 > a and not is_vowel(ipa[b - 1][:1]) else b)
    return [list(ipa[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ipa)])]


def weight(syllable: Sequence[str]) -> str:
    """light, heavy or superheavy."""
    nucleus = [k for k, s in enumerate(syllable) if is_vowel(s[:1])]
    if not nucleus:
        return "light"
    long = len(nucleus) > 1 or any("ː" in syllable[k] for k in nucleus)
    coda = len(syllable) - 1 - nucleus[-1]
    if long and coda or coda > 1:
        return "superheavy"
    return "heavy" if long or coda else "light"


def stress_index(sylls: Sequence[Sequence[str]], spec: Spec) -> int:
    """Index of the stressed syllable."""
    n = len(sylls)
    if n <= 1:
        return 0
    if spec.stress == "weight":
        if weight(sylls[-1]) == "superheavy":
            return n - 1
        return n - 2 if n == 2 or weight(sylls[-2]) != "light" else n - 3
    return {"final": n - 1, "penult": n - 2, "initial": 0, "antepenult": max(n - 3, 0)}[spec.stress]


def collapse(segments: Sequence[str]) -> list[str]:
    """Identical adjacent consonants become one."""
    out: list[str] = []
    for s in segments:
        if not out or s != out[-1] or is_vowel(s[:1]) or s in ("ː", "ˑ"):
            out.append(s)
    return out


def dock_tone_marks(ipa: str, marks: str = "˥˦˧˨˩") -> str:
    """Move tone letters from inside a syllable to its end; doing so twice changes nothing."""
    parts, held, seen = [], "", False
    for s in segment_ipa(ipa):
        if s[:1] in marks or s.strip(marks) == "":
            held += s
            continue
        body = "".join(c for c in s if c not in marks)
        tones = "".join(c for c in s if c in marks)
        if held and seen and is_vowel(body[:1]) and parts and not is_vowel(parts[-1][:1]):
            parts.insert(len(parts) - 1, held)
            held = ""
        parts.append(body)
        seen = seen or is_vowel(body[:1])
        held += tones
    return "".join(parts) + held


def slot_confidence(costs: Sequence[float]) -> float:
    if not costs:
        return 0.0
    first = math.exp(-costs[0]) if costs[0] else 1.0
    return first if len(costs) < 2 else (1 - math.exp(-(costs[1] - costs[0]))) * first


@dataclass(frozen=True)
class Reading:
    word: str
    ipa: str
    coverage: float
    confidence: float
    candidates: tuple[str, ...]
    unmapped: str


@dataclass(frozen=True)
class Engine:
    """A language's kernel, with optional user stages."""

    spec: Spec
    width: int = 8
    rescore: Callable[[list[list[Candidate]], list[Token]], list[list[Candidate]]] | None = None
    #: A user's syllabifier of readings: (ipa, language code) to pieces; pieces that do not join to the reading are not taken.
    syllabify: Callable[[str, str], Sequence[str]] | None = None

    def lattice(self, word: str) -> tuple[list[Token], list[list[Candidate]]]:
        tokens = tokenize(word, self.spec)
        graphemes = [t for t in tokens if t.kind == "GRAPHEME"]
        slots = nasal_carriers([branches(graphemes, k, self.spec) for k in range(len(graphemes))])
        return tokens, self.rescore(slots, graphemes) if self.rescore else slots

    def finalise(self, segments: Sequence[str], word: str) -> str:
        segments = collapse([s for s in segments if s])
        if word in self.spec.clitics:
            return "".join(segments)
        sylls = self.divided(segments)
        if len(sylls) < 2:
            return "".join(segments)
        at = stress_index(sylls, self.spec)
        return "".join(("ˈ" if k == at else "") + "".join(s) for k, s in enumerate(sylls))

    def divided(self, segments: Sequence[str]) -> list[list[str]]:
        """Syllables by the user's stage; the library's own where it fails or rewrites."""
        if self.syllabify is not None:
            ipa = "".join(segments)
            try:
                given = list(self.syllabify(ipa, self.spec.code))
                if given and "".join(given) == ipa:
                    return [segment_ipa(s) for s in given]
            except Exception:  # a user's stage: any failure means the library's own answer
                pass
        return syllables(segments)

    def ending(self, word: str) -> tuple[str, str] | None:
        """The longest declared ending that leaves a head."""
        for n in range(len(word) - 1, 0, -1):
            if (found := self.spec.endings.get(word[-n:])) and found[0] is not None:
                return word[:-n], found[0]
        return None

    def read(self, word: str, k: int = 5) -> Reading:
        key = unicodedata.normalize("NFC", lower(word, self.spec.code))
        tokens, slots = self.lattice(key)
        total = len(key)
        missing = [t for t in tokens if t.kind in ("UNKNOWN", "DIGIT")]
        coverage = 1.0 if not total else (total - sum(t.length for t in missing)) / total
        unmapped = "".join(t.grapheme for t in missing)
        forced = self.spec.lexicon.get(key)
        if forced is not None:
            return Reading(word, forced, coverage, coverage, (forced,), unmapped)
        confidence = min((slot_confidence([c.cost for c in s]) for s in slots), default=1.0)
        cut = self.ending(key)
        if cut:
            _, slots = self.lattice(cut[0])
        found: list[str] = []
        for _, path in beam(slots, max(self.width, k)):
            ipa = self.finalise(rewrite([*path, cut[1]] if cut else path, self.spec.rules), key)
            ipa = unicodedata.normalize("NFC", ipa)
            if ipa not in found:
                found.append(ipa)
                if len(found) >= k:
                    break
        found = found or [""]
        return Reading(word, found[0], coverage, confidence * coverage, tuple(found[:k]), unmapped)


def own_engine(lang: str) -> Engine:
    """The engine of one of the library's own languages."""
    from ..sources import spellings as s

    positional: dict[str, dict[str, list[str]]] = {}
    for code, g, p, ipa in s.POSITIONAL.rows:
        if code == lang:
            positional.setdefault(g, {}).setdefault(p, []).append(ipa)
    endings: dict[str, list[str]] = {}
    for code, e, ipa in s.ENDINGS.rows:
        if code == lang:
            endings.setdefault(e, []).append(ipa)
    rules = [Rule(i, p, x, wi, wf, a, b) for code, _, i, p, x, wi, wf, a, b in sorted(s.ALLOPHONE_RULES.rows, key=lambda r: r[1]) if code == lang]
    lexicon = {w: i for code, w, i, _ in sorted(s.LEXICON.rows, key=lambda r: -r[3]) if code == lang}
    return Engine(Spec(lang, s.spelling(lang), {}, positional, rules, endings, lexicon, {"fr": "final", "de": "initial"}.get(lang, "penult")))
