"""Token ids of whole texts by the ``tokenizers`` library.

Words repeat, so a text is cut into pieces, each of which is encoded once per
worker and remembered.  The cuts are exact for the vocabularies used here,
whose pre-tokenizers never let a token cross them: before a space between two
characters that are not white space, around such a line break, and before a
comma or full stop that follows a plain letter or digit.  Texts in which these
characters stand elsewhere are cut at fewer places or encoded as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces remembered by one worker in each of two generations; the older one goes when the newer is full.
REMEMBERED = 900_000
_WHOLE = re.compile(r" (?<!\S )| (?!\S)|[\x1c-\x1f\x85]")
_COARSE = re.compile(r"[,.](?<![0-9A-Za-zÀ-ÖØ-öø-įı-ɏЀ-џ][,.])|\n(?<!\S\n)|\n(?!\S)")
#: A letter beyond Latin: up to there lower case is the same letter by letter in any library.
_WIDE = re.compile("[^\x00-\u024f]")


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies; an existing path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as unsigned 32-bit arrays."""

    def __init__(self, name: str, end: int | None = 1, remembered: int | None = None):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.apart = Tokenizer.from_file(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = "<|endoftext|>"  # only between pieces: apart knows it as one token
        self.mark_id = self.apart.token_to_id(self.mark)
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        ids = lambda x: self.model.encode(x, add_special_tokens=False).ids
        #: Whether the vocabulary ignores case and drops white space, so that pieces can be folded.
        self.folds = ids("A b\nC") == ids("a") + ids("B") + ids("c")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @property
    def size(self) -> int:
        return self.model.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces: many at once, with the mark between them."""
        plain = [x for x in pieces if "<|" not in x]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.apart.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            data = ids.tobytes()
            self.known.update(zip(part, [data[a:b] for a, b in zip([0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)])], strict=True))
        for x in pieces:
            if "<|" in x:
                self.known[x] = self.whole(x)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: empty), with the end id."""
        cut = [self.pieces(x) for x in texts]
        if len(self.known) > (self.remembered or REMEMBERED):
            self.older, self.known = self.known, {"": b""}
        missing = []
        for x in set().union(*(x for x in cut if x)).difference(self.known):
            if (ids := self.older.get(x)) is not None:
                self.known[x] = ids
            else:
                missing.append(x)
        self._learn(missing)
        get = self.known.__getitem__
        return [(self.whole(text) if pieces is None else b"".join(map(get, pieces))) + self.end for text, pieces in zip(texts, cut)]

    def pieces(self, text: str | None) -> list[str] | None:
        """A text cut at its exact places; None if it is to be encoded as a whole."""
        if not text:
            return []
        if _WHOLE.search(text):
            return None
        fine = not _COARSE.search(text)
        if self.folds and not _WIDE.search(text):
            text, line = text.lower().replace(" ", "\x1f"), "\x1f"
        else:
            text, line = text.replace(" ", "\x1f "), "\x1f\n\x1f"
        if fine:
            text = text.replace(",", "\x1f,").replace(".", "\x1f.").replace("\n", line)
        return text.split("\x1f")


_ENCODERS: dict[tuple[str, int | None, int | None], Encoder] = {}


def encoder(name: str, end: int | None = 1, remembered: int | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = name, end, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, end, remembered)
    return _ENCODERS[key]
