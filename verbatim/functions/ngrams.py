"""Word n-grams for exact keyword lookups.

Matching a keyword on word boundaries is turned into set membership: the text becomes a word array in which
punctuation and repeated spaces stand as break tokens, so an n-gram never runs across them. A keyword of word characters
and single spaces then matches on word boundaries exactly if it equals one of the n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatim.functions.expr import among, bind, split_at
from verbatim.functions.patterns import WORD, word_bounded

BREAK = "\x01"
_PLAIN = re.compile(r"\w+(?: \w+)*", re.UNICODE)


def is_plain_keyword(keyword: str) -> bool:
    """Whether the n-gram lookup decides this keyword; others need a pattern."""
    return _PLAIN.fullmatch(keyword) is not None


def match_words(text: Column) -> Column:
    marked = F.regexp_replace(F.lower(text), f"[^{WORD} ]| {{2,}}", f" {BREAK} ")
    return split_at(marked, " +")


def match_line(text: Column) -> Column:
    """The words of ``match_words`` as one text, a space before and behind each: it holds " keyword " where the words do."""
    return F.concat(F.lit(" "), F.array_join(match_words(text), " "), F.lit(" "))


def ngrams(words: Column, n: int) -> Column:
    """All n-grams; the last ones are shorter, which adds no n-gram that is not in the text."""
    if n == 1:
        return words
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))


def _members(values: Column, allowed: list[str]) -> Column:
    return F.filter(values, lambda v: among(v, allowed))


def keyword_hits(words: Column, keywords: Iterable[str]) -> Column:
    """Distinct plain keywords (lower case) found in a ``match_words`` array: a hashed lookup per n-gram."""
    by_length: dict[int, list[str]] = {}
    for k in sorted(set(keywords)):
        by_length.setdefault(len(k.split(" ")), []).append(k)
    if not by_length:
        return F.array().cast("array<string>")

    # The words are bound first: inside a lambda, an unbound array would be computed again for every element.
    def find(w: Column) -> Column:
        found = [_members(ngrams(w, n), terms) for n, terms in sorted(by_length.items())]
        return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])

    return bind(words, find)


def pattern_hits(text: Column, keywords: Iterable[str]) -> Column:
    """Keywords with punctuation inside: a cheap containment test, then the word-bounded pattern."""
    terms = sorted(set(keywords))
    if not terms:
        return F.array().cast("array<string>")
    lowered = F.lower(text)
    found = [
        F.when(F.contains(lowered, F.lit(k)) & lowered.rlike(f"(?iu){word_bounded(k)}"), F.lit(k)) for k in terms
    ]
    return F.array_compact(F.array(*found))
