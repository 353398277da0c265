"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A nested expression that uses its input twice at every level is computed exponentially often; a lambda variable is
    computed once. Only worth it around costly values: lambdas are interpreted.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_at(c: Column, pattern: str, mark: str = " ") -> Column:
    """``split`` at a pattern that matches no empty text, but matches ``mark``.

    Spark compiles the pattern of a split anew for every text, and that of a replacement once.
    """
    return F.split(F.regexp_replace(c, pattern, mark), mark)


def among(c: Column, terms: Iterable[str]) -> Column:
    """``isin`` for lambdas, where a list of up to ten terms is built again for every value; more are a set."""
    terms = list(terms)
    return reduce(lambda a, b: a | b, [c == t for t in terms]) if 0 < len(terms) <= 10 else c.isin(*terms)


def _free_names(df: DataFrame, n: int) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"_value{i}" for i in range(n + len(taken))) if name not in taken][:n]


def explode_rows(df: DataFrame, keep: list[str], values: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form is filtered afterwards on purpose: for the plain form the optimizer infers a filter on the array's
    size and pushes it below, which computes a costly array twice. The array is a column first: Spark compiles what a
    projection computes, but not what a generator does.
    """
    pos = position or "_pos"
    (array,) = _free_names(df, 1)
    out = df.withColumn(array, values).select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())
    return out if position else out.drop(pos)


def compute_all(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters and projections read them instead of computing them again.

    A filter on a computed column is normally pushed below the projection that computes it, with the whole expression
    copied into it. Nothing is pushed below a generator's output, and generating one row costs next to nothing. The values
    are columns first: Spark compiles what a projection computes, but not what a generator does.
    """
    names = _free_names(df, len(values))
    row = F.struct(*[F.col(c).alias(n) for n, c in zip(values, names, strict=True)])
    others = ["`" + c.replace("`", "``") + "`" for c in df.columns if c not in values]
    return df.withColumns(dict(zip(names, values.values(), strict=True))).select(*others, F.inline(F.array(row)))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return compute_all(df, {name: value})


def round_binary(value: Column, digits: int) -> Column:
    """Round a double as exact arithmetic on its binary value does, a true tie to the even digit.

    ``round`` and ``bround`` look at the shortest decimal print, which may show a tie where the value lies beside it. Here the
    scaled value is rounded to a double first; only if that is a tie can it be on the wrong side, and the error of the
    product, computed exactly by splitting the factor, tells which side is right.
    """
    scale = float(10**digits)
    scaled = value * F.lit(scale)
    spread = value * F.lit(134217729.0)  # 2 ** 27 + 1
    high = spread - (spread - value)
    error = (high * F.lit(scale) - scaled) + (value - high) * F.lit(scale)
    floor = F.floor(scaled)
    part = scaled - floor
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (floor % 2 != 0))))
    return (floor + up.cast("long")).cast("double") / F.lit(scale)
