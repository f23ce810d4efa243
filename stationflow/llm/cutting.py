"""Cutting text where no byte-level pre-token can reach across, remembering what was made of parts, and well-formed text.

A pre-token either holds no white space behind its first character, or nothing but white space. So
at a space that follows a character which is no white space a pre-token always begins, and the text
may be encoded in parts that start there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Python's white space holds all that pre-tokenizers count as such; a few characters more only join parts.
_AFTER_WHITE = re.compile(r"\s (?<=\s\s)").search
_WHITE_END = re.compile(r"\s\Z").search


def spaced_parts(text: str) -> list[str]:
    """Parts p0, p1, ... with ``text == p0 + " " + p1 + " " + p2 ...``, each of which can be encoded alone."""
    parts = text.split(" ")
    if parts[0] and not _AFTER_WHITE(text):
        return parts
    out: list[str] = []
    held = [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if not before or _WHITE_END(before):  # this space follows white space, or begins the text
            held.append(part)
        else:
            out.append(" ".join(held))
            held = [part]
    out.append(" ".join(held))
    return out


class Recent(dict):
    """What ``make`` gives for a key, remembered for the keys used last; never more than two times ``most``."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def well_formed(text: str) -> str:
    """Lone surrogates become U+FFFD; pairs of them become the character they stand for."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
