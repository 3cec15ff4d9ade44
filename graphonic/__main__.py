"""Command line: ``python -m graphonic [--json] COMMAND ...``; exit 0, 1 (failed) or 2 (usage)."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from .functions import engine as e
from .functions import syllables as y
from .functions import utterance as u
from .functions.phones import segment_distance
from .sources.spellings import LANGUAGES
from .sources.validation import validate

USAGE = """usage: python -m graphonic [--json] COMMAND ...
  list                      languages with a spelling table
  info LANG                 sizes of a language's tables
  validate FILE             faults of a spec document
  transcribe LANG TEXT      readings of the words of a text
  word LANG WORD            a word's reading, coverage and confidence
  word-candidates LANG WORD [N]
  lattice LANG WORD         the readings of each slot with their costs
  beam LANG WORD [WIDTH]    the cheapest paths
  tokens LANG TEXT          the tokens of a text
  stress LANG WORD          the syllables and the stressed one
  tone TEXT                 tone letters moved to the ends of their syllables
  resolve TAG               the parts of a language tag
  distance PHONE PHONE"""


def _engine(lang: str) -> e.Engine:
    if lang not in LANGUAGES:
        raise KeyError(f"no spelling table: {lang}")
    return e.own_engine(lang)


def _info(lang: str) -> dict:
    spec = _engine(lang).spec
    return {"code": spec.code, "graphemes": len(spec.graphemes), "positional": len(spec.positional), "rules": len(spec.rules), "lexicon": len(spec.lexicon), "stress": spec.stress}


def _validate(path: str) -> list:
    found = validate(Path(path).read_text("utf-8"))
    if found:
        raise ValueError("; ".join(f"{loc}: {msg} [{kind}]" for loc, msg, kind in found))
    return []


def _transcribe(lang: str, text: str) -> str:
    own = _engine(lang)
    return " ".join(own.read(w, 1).ipa for w in text.split())


def _word(lang: str, word: str) -> dict:
    r = _engine(lang).read(word)
    return {"word": r.word, "ipa": r.ipa, "coverage": r.coverage, "confidence": r.confidence}


def _stress(lang: str, word: str) -> dict:
    ipa = _engine(lang).read(word, 1).ipa
    parts = y.syllabify_ipa(ipa.replace(y.PRIMARY, ""))
    at = len(y.syllabify_ipa(ipa.split(y.PRIMARY)[0])) if y.PRIMARY in ipa else 0
    return {"ipa": ipa, "syllables": parts, "stressed": at}


def _tokens(lang: str, text: str) -> list:
    return [{"kind": t.kind, "grapheme": t.grapheme, "ipa": list(t.ipa), "position": t.position, "length": t.length} for t in e.tokenize(text, _engine(lang).spec)]


#: Each command, and how many arguments it takes at least and at most.
COMMANDS = {
    "list": (lambda: list(LANGUAGES), 0, 0), "info": (_info, 1, 1), "validate": (_validate, 1, 1), "transcribe": (_transcribe, 2, 2), "word": (_word, 2, 2),
    "word-candidates": (lambda lang, w, n="5": list(_engine(lang).read(w, int(n)).candidates), 2, 3),
    "lattice": (lambda lang, w: [[[c.ipa, c.cost] for c in slot] for slot in _engine(lang).lattice(w)[1]], 2, 2),
    "beam": (lambda lang, w, n="8": [[cost, list(path)] for cost, path in e.beam(_engine(lang).lattice(w)[1], int(n))], 2, 3),
    "tokens": (_tokens, 2, 2), "stress": (_stress, 2, 2), "tone": (e.dock_tone_marks, 1, 1), "resolve": (lambda tag: [list(p) for p in u.parse_tag(tag)], 1, 1), "distance": (segment_distance, 2, 2),
}


def main(argv: list[str]) -> int:
    as_json = "--json" in argv
    name, *args = [a for a in argv if a != "--json"] or [""]
    command, least, most = COMMANDS.get(name, (None, 0, 0))
    if command is None or not least <= len(args) <= most:
        print(USAGE, file=sys.stderr)
        return 2
    try:
        found = command(*args)
    except (ValueError, KeyError, OSError) as x:
        print(json.dumps({"error": str(x.args[0] if x.args else x), "type": type(x).__name__}, ensure_ascii=False) if as_json else f"error: {x}", file=sys.stdout if as_json else sys.stderr)
        return 1
    if as_json or isinstance(found, dict):
        print(json.dumps(found, ensure_ascii=False))
    else:
        print(*(found if isinstance(found, list) else [found]), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
