"""Splitting a text where a byte-level BPE tokenizer cannot join its tokens.

The pre-token pattern attaches at most one leading space to a token, so a
text may be cut before every single space that has no other white space
beside it: tokens never cross such a place. The pieces ("words" with their
leading space) repeat a lot, so a task encodes each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc


#: White space other than the space, among ASCII and beyond (str.isspace).
ASCII_SPACE = "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_SPACE = ("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
               "\u200a\u2028\u2029\u202f\u205f\u3000")


def words_of(text: str) -> list[str] | None:
    """The text's parts between single spaces, or None if some space has
    white space (or an end of the text) beside it: then the text must be
    encoded as a whole."""
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return None
    for c in ASCII_SPACE if text.isascii() else ASCII_SPACE + OTHER_SPACE:
        if c in text and (" " + c in text or c + " " in text):
            return None
    return text.split(" ")


def blocks(texts, max_chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of an Arrow string column whose texts have about
    ``max_chars`` bytes together (one row at least), so that memory does not
    depend on the Arrow batch."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > start and held + n > max_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


class WordCache(dict):
    """word -> encoding of " " + word, made at the first look-up. When
    ``limit`` entries are held they become the old generation; words met again
    are taken over from it, so frequent words stay and at most twice
    ``limit`` entries are held."""

    def __init__(self, encode, limit: int = 400_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.encode(" " + word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out
