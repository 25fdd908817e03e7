"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary splits a text before a blank that stands between two other characters, and merges
never cross such a split.  So a text is cut at those blanks, each distinct unit is encoded once per
worker, and the ids of a text are the joined ids of its units.
"""

from __future__ import annotations

import array
import base64
import re
import string
import sys

import tiktoken

from .batches import kept

#: Units a worker remembers; later ones are encoded each time.
REMEMBERED = 500_000
#: Units longer than this many characters are encoded but not remembered.
LONG_UNIT = 64

#: White space other than the blank.  Next to a blank it moves the vocabulary's own split.
_OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c != " "]
#: ASCII marks that stand apart from letters and digits before them.
_MARKS = string.punctuation
_PLAIN = re.compile(r"[A-Za-z0-9]\Z")


def _plain_blanks(text: str) -> bool:
    """Whether every blank stands between two characters that are not white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACE)


class _Units(dict):
    """Unit to ids, filled on demand.  Marks at the end of a unit are encoded apart from it."""

    def __init__(self, encoder: tiktoken.Encoding, prefix: str) -> None:
        super().__init__()
        self.encoder, self.prefix, self.marks = encoder, prefix, {}

    def encoded(self, text: str) -> bytes:
        return array.array("I", self.encoder.encode_ordinary(text)).tobytes()

    def __missing__(self, unit: str) -> bytes:
        stem = unit.rstrip(_MARKS)
        if len(stem) < len(unit) and _PLAIN.search(stem):
            tail = unit[len(stem):]
            ids = self[stem] + (self.marks.get(tail) or self.marks.setdefault(tail, self.encoded(tail)) if len(tail) <= 4 else self.encoded(tail))
        else:
            ids = self.encoded(self.prefix + unit)
        if len(unit) <= LONG_UNIT and len(self) < REMEMBERED:
            self[unit] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.  Special token strings are ordinary text."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Units(self.encoder, ""), _Units(self.encoder, " ")

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text; none for a null or empty one."""
        if not text:
            return b""
        if not _plain_blanks(text):
            return self.first.encoded(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker, built once."""
    return kept(("encoder", path, pattern), lambda: Encoder(path, pattern))
