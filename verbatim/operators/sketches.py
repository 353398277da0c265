"""Distinct counts and quantiles as sketches that are stored once per facet and merged for any view.

An exact distinct count or median has to see the rows again for every filter. A sketch per combination of facet values is a
few kilobytes, whatever the number of rows, and the sketches of the combinations that a view selects merge into the view's. Row
counts stay exact. ``reports.view_metrics`` and ``profile`` are the exact forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three standard errors of a distinct count with 2**14 registers, and the rank error of a quantile with k = 200.
LOG_REGISTERS = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 0.03
QUANTILES = (0.25, 0.5, 0.75)


def facet_sketches(view: DataFrame, facets: Sequence[str], key: str, value: str) -> DataFrame:
    """One row per combination of facet values: ``rows``, a sketch of the distinct keys and one of the values."""
    return view.groupBy(*facets).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(key, LOG_REGISTERS).alias("keys"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"),
    )


def merged_metrics(sketches: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``rows``, ``unique_ids`` and ``quantiles`` of the sketches left by any filter, in all or per value of ``by``."""
    merged = sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.hll_union_agg("keys").alias("keys"),
        F.kll_merge_agg_double("values").alias("values"),
    )

    def at(rank: float) -> Column:
        filled = F.kll_sketch_get_n_double("values") > 0
        return F.when(filled, F.kll_sketch_get_quantile_double("values", F.lit(rank)))

    return merged.select(
        *by, "rows", F.hll_sketch_estimate("keys").alias("unique_ids"), F.array(*[at(r) for r in quantiles]).alias("quantiles")
    )
