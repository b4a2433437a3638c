"""Pre-splitting patterns for the characters whose classes are the same in every Unicode version."""

from __future__ import annotations

import re
import unicodedata

#: Characters below it, and common punctuation, are split here; texts with others go to the library.
LIMIT = 0x250
#: Control characters that Python, but not Unicode, takes as white space.
_ODD = "\x1c\x1d\x1e\x1f\x85"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LIMIT) if unicodedata.category(chr(c))[0] == kind)


LETTERS, NUMBERS = _class("L"), _class("N")
#: Finds a character that the patterns here are not made for.
RARE = re.compile(f"[{_ODD}]|[^\x00-{chr(LIMIT - 1)}{''.join(map(chr, [*range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122]))}]")


def plain(pattern: str, ascii_only: bool):
    """findall of pattern, in which LETTERS and NUMBERS stand for character classes' insides."""
    if ascii_only:
        return re.compile(pattern.replace("LETTERS", "A-Za-z").replace("NUMBERS", "0-9"), re.A).findall
    return re.compile(pattern.replace("LETTERS", LETTERS).replace("NUMBERS", NUMBERS)).findall
