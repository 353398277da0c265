"""Regex pieces with one meaning in every place they are used.

The built-in ``\\w``, ``\\s`` and ``\\b`` differ between regex engines (and between Java releases), so character classes
are spelled out and word boundaries are look-arounds over the same class. All patterns built here are literals, so
Spark compiles each of them once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = r"\p{L}\p{N}_"
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

STRIP_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000]
)

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-&~#])")
_EDGE_WORD = re.compile(r"\w", re.UNICODE)


def quote(literal: str) -> str:
    """Escape a literal for use inside a pattern."""
    return _SPECIAL.sub(r"\\\1", literal)


def quote_replacement(literal: str) -> str:
    """Escape a literal for use as a replacement, where ``$`` and ``\\`` are special."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def word_bounded(literal: str) -> str:
    """The literal between word boundaries.

    Next to a word character the boundary means "no word character outside"; next to any other character it means
    the opposite, as a word boundary does.
    """
    left = f"(?<![{WORD}])" if _EDGE_WORD.match(literal[0]) else f"(?<=[{WORD}])"
    right = f"(?![{WORD}])" if _EDGE_WORD.match(literal[-1]) else f"(?=[{WORD}])"
    return f"{left}{quote(literal)}{right}"


def outside(chars: str) -> str:
    """One character outside a class. Java scans this several times faster than a negated class of mixed parts."""
    return f"(?:(?![{chars}])(?s:.))"


def any_term(terms: Iterable[str]) -> str:
    """One case-insensitive alternation of word-bounded terms; a trailing ``*`` allows further word characters."""
    parts = [quote(t[:-1]) + f"[{WORD}]*" if t.endswith("*") else quote(t) for t in terms]
    return f"(?iu)(?<![{WORD}])(?:{'|'.join(parts)})(?![{WORD}])"
