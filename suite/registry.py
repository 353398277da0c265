"""The registry: one entry per inventory item, with its SQL twin where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for query output: below the cluster's shared folder, or a temporary one in local tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/verbatim-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="verbatim-")
