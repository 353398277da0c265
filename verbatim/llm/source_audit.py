"""How far the word use of sources diverges, per language, with copies of a text counted but read once.

Equal texts of a language are collapsed first: counts per source are combined by the text's 128-bit hash, and one copy of the
text goes on with its sources and their multiplicities. Only that copy is cut into terms. A term's count in a source is the sum of
its occurrences times the multiplicity, its document frequency the sum of the multiplicities; both add up before the shuffle.
Terms that too few documents of the language hold are left out.

A source and its language give each kept term a share, in billionths and smoothed, as an integer. The divergence of two shares
p and q is (p - q)**2 / (p + q), rounded down. Summed over all kept terms it compares two sources. Most terms occur in few sources, so the
sum is taken sparsely: a term that neither source holds adds the same amount every time; what a source's own terms add
against the other's empty share follows from the counts of its distinct shares; only terms that both hold are joined, to put
right what the first two parts took for them. All arithmetic is on integers and exact.

Defined results: null texts, languages and sources read as empty ones; a language without kept terms compares its sources with 0;
a language with one source has no pair; a document is a row, repeated rows count each; ties go to the item that is first in
UTF-8; an empty table gives an empty one; other columns are not looked at. The number of a text's sources, not of its copies,
bounds the list that travels with it. The pairs of sources in the result grow with the square of a language's sources, as asked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.llm.common import stored

#: Bytes that belong to terms, A-Z lower-cased, all others as blanks: letters and whatever is not ASCII.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1_000_000_000
#: Places that rows of one language are dealt to where they meet its sources.
SALTS = 32


@dataclass(frozen=True)
class Audit:
    """``min_docs`` documents of a language keep a term; ``top_terms`` are reported per source."""

    min_docs: int = 10
    top_terms: int = 10


def term_counts(text: Column) -> Column:
    """The distinct terms of each text with their counts, array<struct<term, tf>>."""

    @F.arrow_udf("array<struct<term string, tf bigint>>")
    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            terms, numbers, ends = [], [], [0]
            for text in batch:
                found = Counter((text.as_py() or "").encode().translate(FOLD).split())
                terms.extend(found)
                numbers.extend(found.values())
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["term", "tf"])
            yield pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pairs)

    return counts(text)


def collapsed(docs: DataFrame, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(lang, source) of all documents, and (text, lang, sources: array<struct<source, n>>) of the distinct texts of each lang."""
    blank = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(blank(lang, "lang"), blank(source, "source"), blank(text, "text"))
    rows = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit("text"), "text")})
    same = ["lang", "d1", "d2"]
    copies = stored(rows.groupBy(*same, "source").agg(F.count("*").alias("n")), "copies")
    sources = copies.groupBy(*same).agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = rows.groupBy(*same).agg(F.first("text").alias("text"))
    return copies.select("lang", "source").distinct(), texts.join(sources, same).select("lang", "text", "sources")


def counted_terms(texts: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents, copies included."""
    each = texts.select("lang", "sources", F.explode(term_counts(F.col("text"))).alias("t"))
    each = each.select("lang", "t.term", "t.tf", F.inline("sources"))
    return each.groupBy("lang", "source", "term").agg(F.sum(F.col("tf") * F.col("n")).alias("c"), F.sum("n").alias("d"))


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * vocabulary)), by long division in thousands, so that nothing overflows."""
    whole = total + 2 * vocabulary
    rest, value = count + F.lit(2), F.lit(0).cast("long")
    for _ in range(3):
        value = value * 1000 + div(rest * 1000, whole)
        rest = (rest * 1000) % whole
    return value + F.lit(1)


def div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", settings: Audit | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms that a source uses most above its language."""
    settings = settings or Audit()
    groups, texts = collapsed(docs, text, lang, source)
    counts = stored(counted_terms(texts), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("d"))
    kept = kept.filter(F.col("d") >= settings.min_docs).drop("d")
    langs = kept.groupBy("lang").agg(F.sum("lang_c").alias("lang_total"), F.count("*").alias("v"))
    terms = stored(counts.join(kept, ["lang", "term"]), "kept-terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count("*").alias("held"))
    none = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "held", "lang_total", "v")])
    p0 = F.when(F.col("v") > 0, share(none, F.col("total"), F.col("v")))
    groups = stored(groups.withColumn("p0", p0), "groups")

    shares = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0",
        share(F.col("c"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_c"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    shares = stored(shares, "shares")
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    pairs = compared(groups, shares).withColumnRenamed("other", "item")
    return ranked(pairs, "pair").unionByName(ranked(above, "term").filter(F.col("rank") <= settings.top_terms))


def ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def compared(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, other, value) for every ordered pair of a language's sources."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.col("held").alias("other_held"), spread.alias("salt"))
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    pairs = salted(groups, "source").join(other, ["lang", "salt"]).filter(F.col("source") != F.col("other"))
    unheld = divergence(F.col("p0"), F.col("other_p0"))
    pairs = pairs.select("lang", "source", "other", (unheld * (F.col("v") - F.col("held") - F.col("other_held"))).alias("value"))

    # What the terms of ``source`` add if the other source held none of them, to both directions.
    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = salted(steps, "source", "p").join(other, ["lang", "salt"]).filter(F.col("source") != F.col("other"))
    alone = alone.select("lang", "source", "other", (divergence(F.col("p"), F.col("other_p0")) * F.col("times")).alias("value"))

    # Terms of both sources: their divergence instead of what the two parts above took for them.
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    both = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("other"))
    p, p0, r, r0 = (F.col(c) for c in ("p", "p0", "r", "r0"))
    mended = divergence(p, r) - divergence(p, r0) - divergence(p0, r) + divergence(p0, r0)
    both = both.select("lang", "source", "other", mended.alias("value"))

    swapped = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    alone, both = (df.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")) for df in (alone, both))
    parts = pairs.unionByName(alone).unionByName(swapped(alone)).unionByName(both).unionByName(swapped(both))
    return parts.groupBy("lang", "source", "other").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
