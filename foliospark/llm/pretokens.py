"""Splitting text into chunks that byte-level BPE encodes independently, with bounded caches.

A chunk is a run of white space with the non-space characters after it. None of the published
split pattern's alternatives goes on from a non-space character into white space, so chunks are
encoded one by one and the results concatenated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: The white space of the Unicode property, as the tokenizer libraries read \s.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What keeps a text from the fast path, which knows single spaces and newlines only.
_UNUSUAL = re.compile("[\\0\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_CHUNK = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Entries of a cache; it is emptied when full.
CACHE_ENTRIES = 400_000


def pattern(source: str) -> regex.Pattern:
    """The library's split pattern with \\s as the Unicode property (Python's \\s also has U+001C to U+001F)."""
    return regex.compile(source.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]"))


def _plain(text: str) -> bool:
    """Whether white space is single spaces and newlines between other characters."""
    ends = text[:1] + text[-1:]
    return not (" " in ends or "\n" in ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _UNUSUAL.search(text))


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined, they are the text."""
    return _CHUNK.findall(text)


class ChunkCache:
    """Encodes texts chunk by chunk; encode(chunk) gives a chunk's value, which is kept in a bounded cache."""

    def __init__(self, encode: Callable[[str], object], entries: int = CACHE_ENTRIES):
        self.encode, self.entries = encode, entries
        self.known: dict[str, object] = {}

    def values(self, text: str) -> list:
        """The values of the text's chunks, in order."""
        if not text:
            return []
        if not _plain(text):
            keys: Iterable[str] = ["\x00" + c for c in chunks(text)]
        else:
            keys = ("\x00" + text).replace("\n", " \n").split(" ")
        known = self.known
        out = list(map(known.get, keys))
        if None in out:
            at = -1
            try:
                while True:
                    at = out.index(None, at + 1)
                    key = keys[at]
                    out[at] = known.get(key)
                    if out[at] is None:
                        if len(known) >= self.entries:
                            known.clear()
                        chunk = key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key
                        out[at] = known[key] = self.encode(chunk)
            except ValueError:
                pass
        return out
