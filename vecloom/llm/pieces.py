"""Splitting text into the pieces that byte-level BPE merges within, and a bounded piece cache."""

from __future__ import annotations

import re
from functools import cache

import regex

#: Characters outside the blocks below may be newer than the Unicode tables of a tokenizer library,
#: which then splits around them differently; texts that hold one are given to the library to split.
ODD = regex.compile(r"[^\u0000-\u0557\u2000-\u206F\u20A0-\u20BF\u2100-\u2BFF\u3040-\u30FF\u4E00-\u9FEF\uAC00-\uD7A3\uFF00-\uFFDC\U0001F300-\U0001F64F]")


#: Texts of these characters alone: here Python's own engine has the pattern's classes, and is faster.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*").fullmatch
PLAIN_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


@cache
def any_split():
    """Text -> the pieces of public_tokenizers.PATTERN, by this module's Unicode tables."""
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN).findall


def pieces_of(text: str) -> list[str] | None:
    """The pieces of public_tokenizers.PATTERN; None for a text with characters of rare blocks."""
    if PLAIN(text):
        return PLAIN_SPLIT(text)
    return None if ODD.search(text) else any_split()(text)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceCache(dict):
    """Piece -> value of make(piece). Emptied when it holds `most` pieces, so memory is bounded."""

    def __init__(self, make, most: int = 600_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value
