"""Vector expressions and the built-in deterministic encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatim.functions.expr import bind
from verbatim.functions.sentiment import words


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, inside the JVM. For many pairs per row use the batched matcher instead."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    def scale(norm: Column) -> Column:
        return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))

    # The norm is bound first, or it would be computed again for every element.
    return bind(F.sqrt(dot(v, v)), scale)


def hash_buckets(c: Column, dim: int) -> Column:
    """Bucket number of each word, by the first four hex digits of its MD5 so that any engine can repeat it."""
    kept = F.filter(words(c), lambda t: t != "")
    return F.transform(
        kept, lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(dim))
    )


def hashed_encoder(dim: int = 64):
    """Encoder of unit-length hashed bags of words: text column -> array<double>; null stays null."""

    @F.arrow_udf("array<double>")
    def encode(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        lengths = np.asarray(buckets.value_lengths().fill_null(0), dtype=np.int64)
        rows = np.repeat(np.arange(n), lengths)
        counts = np.zeros((n, dim))
        np.add.at(counts, (rows, np.asarray(buckets.flatten(), dtype=np.int64)), 1.0)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit_rows = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32)
        mask = np.asarray(buckets.is_null())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit_rows.ravel()), mask=pa.array(mask))

    return lambda c: encode(F.when(c.isNotNull(), hash_buckets(c, dim)))
