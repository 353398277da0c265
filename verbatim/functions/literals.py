"""Driver-side lookup tables as plan literals.

Small dictionaries and taxonomies ride inside the plan: no join, no shuffle, and the operators stay usable on a stream.
Spark searches a literal map entry by entry, so larger maps are spread over buckets by a hash both sides compute alike.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: Any, schema: str) -> Column:
    """A nested literal of the given type; Catalyst folds it into one constant."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def lookup(key: Column, mapping: Mapping[str, Any], value_schema: str) -> Column:
    """Value of a string key, null where absent, without a join."""
    n_buckets = max(1, len(mapping) // 4)
    buckets: list[dict[str, Any]] = [{} for _ in range(n_buckets)]
    for k, v in mapping.items():
        buckets[zlib.crc32(k.encode("utf-8")) % n_buckets][k] = v
    table = literal(buckets, f"array<map<string, {value_schema}>>")
    bucket = F.get(table, (F.crc32(key.cast("binary")) % n_buckets).cast("int"))
    return F.element_at(bucket, key)


def element(table: Sequence[Any], index: Column, schema: str) -> Column:
    """Entry of a literal array by 0-based position."""
    return F.get(literal(list(table), f"array<{schema}>"), index)
