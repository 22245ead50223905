"""Pre-tokens of byte-level BPE: the matches of the public split pattern.

Texts of Latin, Greek, Cyrillic and common punctuation alone go through the same pattern written out
for Python's ``re``, whose character classes are made by rule from the Unicode data; all others go
through the general splitter that the caller gives.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

_LIMIT = 0x530  # characters below have had the same class in every Unicode version in use
_PLAIN = re.compile("[\x00-ԯ‐-‧]*")


def _class(kind: str) -> str:
    """Ranges of a character class of characters whose category starts with ``kind``."""
    out, start = [], None
    for cp in range(_LIMIT + 1):
        inside = cp < _LIMIT and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{cp - 1:04x}")
            start = None
    return "".join(out)


_L, _N, _S = _class("L"), _class("N"), r"\t-\r \x85\xa0"
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def is_plain(text: str) -> bool:
    return text.isascii() or _PLAIN.fullmatch(text) is not None


def pre_tokens(text: str, general: Callable[[str], list[str]]) -> list[str]:
    return _SPLIT.findall(text) if is_plain(text) else general(text)
