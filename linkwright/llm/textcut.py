"""Cuts of a text at which byte-level pre-tokenization certainly has a boundary.

The pre-tokenizer pattern never lets a piece run on from a non-space character
into white space, so a text may be cut before every single space that stands
between two characters that are not white space. Words repeat, so the codes of
the resulting chunks are worth caching.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Every character that any of the regular-expression engines counts as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_SPACE_SET = frozenset(SPACES)


def cuttable(text: str, space: str = " ") -> bool:
    """True if no ``space`` touches other white space, so every one of them is a boundary."""
    return not any(space + c in text or c + space in text for c in SPACES if c in text)


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut at certain boundaries only."""
    start, n = 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while 0 <= at < n - 1 and (text[at - 1] in _SPACE_SET or text[at + 1] in _SPACE_SET):
            at = text.find(" ", at + 1)
        if at < 0 or at >= n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]
