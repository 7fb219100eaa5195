"""Splitting text into pre-tokens, exactly as the byte-level vocabularies' pattern does."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which ``re``'s \s, \d and \w mean White_Space, \p{N} and [\p{L}\p{N}_]: no separators x1C-x1F, no superscripts
#: or fractions, no combining marks. Tests compare all of them with the ``regex`` module.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def _full():
    import regex

    return regex.compile(PATTERN)


def split(text: str) -> list[str]:
    """All matches of :data:`PATTERN`; plain texts take the faster ``re`` engine."""
    return (_PLAIN_SPLIT if _PLAIN.fullmatch(text) else _full()).findall(text)
