"""Phrase curation: regional spelling, canonical form, reply parsing, similarity and quality scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.expr import bind
from verbatim.functions.patterns import WORD, WS, quote_replacement, word_bounded
from verbatim.functions.text import collapse_spaces, replace_if_present, strip, tokens


def _flags(lower_case: bool) -> str:
    return "" if lower_case else "(?iu)"


def uk_spelling(c: Column, lower_case: bool = False) -> Column:
    """Regional spelling; ``lower_case`` says the text is lower-case already, which makes the patterns cheaper."""
    out = c
    for us, uk in lx.UK_SPELLINGS.items():
        out = replace_if_present(out, us, _flags(lower_case) + word_bounded(us), uk, lower_case)
    return out


def uk_terms(c: Column, lower_case: bool = False) -> Column:
    """Regional vocabulary, then ``manager`` as ``line manager`` unless it already is one."""
    out = c
    for term, replacement in lx.US_TO_UK_TERMS.items():
        stem = term.removesuffix("(s)")
        plural = "s?" if term.endswith("(s)") else ""
        pattern = f"{_flags(lower_case)}(?<![{WORD}]){stem}{plural}(?![{WORD}])"
        out = replace_if_present(out, stem, pattern, quote_replacement(replacement), lower_case)
    manager = f"{_flags(lower_case)}(?<!line )(?<![{WORD}])manager(?![{WORD}])"
    return replace_if_present(out, "manager", manager, "line manager", lower_case)


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Plain ASCII is already normal, so only other text travels to Python."""

    @F.arrow_udf("string")
    def normalise(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())

    return F.coalesce(normalise(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def canonical_phrase(c: Column) -> Column:
    """Trim, NFKC, collapse spaces, regional wording, lower case, no punctuation at the edges."""
    text = F.lower(collapse_spaces(nfkc(strip(F.coalesce(c, F.lit(""))))))
    # A text with none of the words is left alone by every replacement; this test is compiled, the replacements are not.
    needles = [*lx.UK_SPELLINGS, *(t.removesuffix("(s)") for t in lx.US_TO_UK_TERMS), "manager"]
    concerned = reduce(or_, [F.contains(text, F.lit(n)) for n in needles])
    regional = F.when(concerned, F.lower(uk_terms(uk_spelling(text, True), True))).otherwise(text)
    return F.btrim(regional, F.lit(lx.PHRASE_EDGE_CHARS))


def is_generic_phrase(c: Column) -> Column:
    """Too short, banned, or a bare need/want/more word plus one word."""
    pattern = f"^(?:{'|'.join(lx.GENERIC_LEADS)})[{WS}]+[{WORD}]+$"
    return (F.size(tokens(c)) < 2) | c.isin(*lx.HARD_BAN) | c.rlike(pattern)


def parse_phrases(content: Column) -> Column:
    """The phrase list in a JSON reply: a bare array, a list under a known key, or the first bracketed span.

    A text with anything after its end is no JSON, so lists are checked whole before they are read. Items that are no strings
    appear as the words ``None``, ``True`` and ``False`` or as the number stands there; lists within lists give no phrase.
    """
    span = F.regexp_extract(content, r"(\[[\s\S]*\])", 1)
    text = strip(content)
    is_object = text.startswith("{") & text.endswith("}")
    keyed = [F.when(is_object, _flat_list(F.get_json_object(content, f"$.{k}"))) for k in lx.PHRASE_LIST_KEYS]
    return F.coalesce(_flat_list(content), *keyed, _flat_list(span), F.array().cast("array<string>"))


#: One item of a flat JSON list, and the whole list.
_ITEM = r'"(?:[^"\\\x00-\x1f]|\\.)*+"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null'
_LIST = rf"^\s*\[\s*(?:(?:{_ITEM})(?:\s*,\s*(?:{_ITEM}))*+)?\s*\]\s*\z"
_WORDS = {"null": "None", "true": "True", "false": "False"}


def _flat_list(text: Column) -> Column:
    """The items of a JSON list of plain values, as strings; null where the text is anything else."""

    def item(token: Column) -> Column:
        out = F.when(token.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0)))
        for word, name in _WORDS.items():
            out = out.when(token == word, name)
        return out.otherwise(token)

    return F.when(text.rlike(_LIST), F.transform(F.regexp_extract_all(text, F.lit(f"({_ITEM})"), F.lit(1)), item))


def word_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(c, F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets (arrays without duplicates); 0 where one is empty."""

    def similarity(s: Column) -> Column:
        sizes = F.size(s["a"]) + F.size(s["b"])
        both = (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0)
        common = F.size(F.array_intersect(s["a"], s["b"]))
        return F.when(both, bind(common, lambda n: n / (sizes - n))).otherwise(0.0)

    return bind(F.struct(a.alias("a"), b.alias("b")), similarity)


def phrase_quality(
    phrase: Column,
    subtheme: Column,
    vocabulary: Iterable[str] = lx.UK_WORKPLACE_VOCAB,
    generic: Iterable[str] = lx.GENERIC_WORDS,
) -> Column:
    """``struct<length, specificity, uk_vocab, not_generic, overall>`` of a phrase for its subtheme.

    Vocabulary terms are looked up as written in the lower-cased phrase, so terms with capitals never hit.
    """
    vocabulary, generic = list(vocabulary), list(generic)

    def score(s: Column) -> Column:
        length = F.when(F.size(tokens(s["text"])).between(5, 15), 1.0).otherwise(0.5)
        n_theme, n_phrase = F.size(s["theme"]), F.size(s["words"])
        overlap = F.size(F.array_intersect(s["theme"], s["words"])) / n_theme
        specificity = F.when(n_theme > 0, F.least(overlap, F.lit(1.0))).otherwise(0.5)
        hit = F.lit(False)
        for term in vocabulary:
            hit = hit | F.contains(s["text"], F.lit(term))
        uk_vocab = F.when(hit, 1.0).otherwise(0.7)
        n_generic = F.size(F.filter(s["words"], lambda w: w.isin(*generic)))
        ratio = F.when(n_phrase > 0, n_generic / n_phrase).otherwise(0.0)
        not_generic = 1.0 - F.least(ratio * 2, F.lit(1.0))
        parts = F.struct(
            length.alias("length"), specificity.alias("specificity"), uk_vocab.alias("uk_vocab"),
            not_generic.alias("not_generic"),
        )
        mean = lambda p: (p["length"] + p["specificity"] + p["uk_vocab"] + p["not_generic"]) / 4
        return bind(parts, lambda p: p.withField("overall", mean(p)))

    lowered = F.lower(phrase)
    inputs = F.struct(
        lowered.alias("text"), word_set(lowered).alias("words"), word_set(F.lower(subtheme)).alias("theme")
    )
    return bind(inputs, score)
