"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements the rules look at and one long whose bit k
says that rule k failed. Policies are named, versioned sets of rules: applying one, or asking what a rule contributes, is
bitwise arithmetic on the ledger and never looks at a text again.

Only Spark expressions are used, one row at a time: no shuffle until the ablation counts distinct masks, of which there
are at most two to the number of rules whatever the number of documents.

Defined results: a null text has no words and so fails ``too_short``; empty and blank texts likewise. Repeated rows
are measured each on its own. Clashing input columns are not touched: the ledger returns its own columns only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.llm.common import SPACES, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters")
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition over the measures, in SQL; null counts as not failed."""

    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


@dataclass(frozen=True)
class RuleBook:
    """The order of the rules gives the bits: append new rules, never reorder, and old ledgers stay readable."""

    rules: tuple[Rule, ...]
    policies: tuple[Policy, ...] = field(default=())

    def bit(self, name: str) -> int:
        return 1 << [r.name for r in self.rules].index(name)

    def mask(self, policy: Policy) -> int:
        return sum(self.bit(r) for r in policy.rules)

    def policy(self, name: str, version: int) -> Policy:
        return next(p for p in self.policies if (p.name, p.version) == (name, version))


BASE = ("too_short", "repeats_itself")
BOOK = RuleBook(
    (
        Rule("too_short", "n_words < 50"),
        Rule("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
        Rule("symbols", "10 * n_symbols > n_words"),
        Rule("shouting", "2 * n_upper > n_letters"),
        Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ),
    (
        Policy("web", 1, (*BASE, "symbols", "shouting", "repeated_lines")),
        # A document of good text may repeat a line often: version 2 only records that rule.
        Policy("web", 2, (*BASE, "symbols", "shouting")),
    ),
)


def measured(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the measures of each text, each computed once.

    A projection that uses a column several times is not merged with the one that makes it, so the arrays below are built
    once per document. Windows are compared by their 64-bit hash within one document only.
    """
    line = F.split(F.col("t"), "\n", -1)
    with_word = F.filter(line, lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = out.select(
        "k",
        words(F.col("t")).alias("w"),
        with_word.alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)])
    )
    out = out.select(
        "k",
        "n_symbols",
        "n_upper",
        "n_letters",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    kept = [c for c in out.columns if c != "h"]
    # Equal windows lie side by side once sorted; texts without any are not sorted at all.
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none).alias("s"))

    def again(x: Column, k: Column) -> Column:
        return (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"])

    out = out.select(*kept, F.sort_array(F.transform(F.filter("s", again), lambda x: x["i"])).alias("p"))
    # A repeated window covers its words up to the start of the next repeated window.
    covers = F.transform("p", lambda p, k: F.least(F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    row = F.struct(*[total.alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])
    # A filter on a measure would be pushed below the arrays, with a copy of each array inside the lambda that walks it. Nothing
    # is pushed below what a generator makes.
    return out.select(F.col("k").alias(key), F.inline(F.array(row)))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", book: RuleBook = BOOK) -> DataFrame:
    """``key``, the measures, and ``failed``: bit k is set where rule k fails."""
    bits = [F.when(F.expr(r.failed), F.lit(book.bit(r.name)).cast("long")).otherwise(F.lit(0).cast("long")) for r in book.rules]
    return measured(docs, key, text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(mask: int, failed: Column | str = "failed") -> Column:
    column = F.col(failed) if isinstance(failed, str) else failed
    return column.bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(table: DataFrame, policy: Policy, book: RuleBook = BOOK) -> DataFrame:
    """The ledger with ``kept`` under this policy."""
    return table.withColumn("kept", ~fails(book.mask(policy)))


def ablation(table: DataFrame, policy: Policy, book: RuleBook = BOOK) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that only it rejects, documents kept without it."""
    mask = book.mask(policy)
    masks = table.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(book.bit(r)).cast("long").alias("bit")) for r in policy.rules])
    each = masks.select("failed", "n", "words", F.inline(rules))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == F.col("bit")
    spared = F.col("failed").bitwiseAND(F.lit(mask).cast("long").bitwiseAND(F.bitwise_not(F.col("bit")))) == 0
    count = lambda c, v="n": F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(hit).alias("fail"),
        count(only).alias("fail_alone"),
        count(spared).alias("kept_without"),
        count(only, "words").alias("words_regained"),
        F.bit_or(F.when(hit, F.col("failed")).otherwise(F.lit(0).cast("long"))).alias("seen_with"),
    )


def keep_good(docs: DataFrame, policy: Policy, key: str = "doc_id", text: str = "text", book: RuleBook = BOOK) -> DataFrame:
    """The documents that the policy keeps, all columns as they came; decided in the row, without a join."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    table = ledger(docs.select(row.alias("row")).select("row", F.col(f"row.{text}").alias("body")), "row", "body", book)
    # The generator keeps the filter from being pushed below the measures and evaluated twice.
    flagged = table.select("row", F.explode(F.array(~fails(book.mask(policy)))).alias("good"))
    return flagged.filter("good").select("row.*")
