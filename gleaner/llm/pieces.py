"""Cutting texts into strings that a tokenizer which lower-cases and drops white space encodes one by one."""

from __future__ import annotations

import re

#: Printable ASCII, ASCII white space, and the bytes of Latin-1 letters, which no normaliser composes.
_KNOWN = bytes([*range(0x21, 0x7F), *b" \t\n\r\x0b\x0c", 0xC3, *range(0x80, 0xC0)])
#: Two signs among the letters.
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")
_MARKS = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
#: Everything but marks, and a table that makes all marks alike.
_OTHERS = bytes(sorted(set(range(256)) - set(_MARKS)))
_ALIKE = bytes(0x21 if b in _MARKS else b for b in range(256))
#: Runs of letters; the contractions that such tokenizers split off (fixed values); single digits; runs of marks.
_PIECES = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")
#: Letters of ASCII, in lower case, and of Latin-1.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def spaced(text: bytes) -> bytes:
    """A text that ASCII white space parts into pre-tokens, or strings of a few, where the given one is all ASCII and Latin-1
    letters without special tokens; else the text itself, which it parts into words.

    Either way the text's ids are the ids of these strings, each encoded alone, in a row.  A mark that has no mark
    beside it is a pre-token, so white space around it changes nothing; an apostrophe may start one and stays where it is.
    """
    low = text.lower()
    if low.translate(None, _KNOWN) or b"<|" in low or any(s in low for s in _SIGNS):
        return text
    if b"!!" in low.translate(_ALIKE):
        return b" ".join(_PIECES.findall(low))
    for mark in set(low.translate(None, _OTHERS)) - {0x27}:
        low = low.replace(b"%c" % mark, b" %c " % mark)
    return low


def cut(text: bytes) -> list[bytes]:
    return spaced(text).split()
