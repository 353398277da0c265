"""What the operators share: the word rule, tables in the shared folder, names that clash with no input column."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.session import ship_package

#: White space that separates words, and the words between it (fixed values).
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Rows per Arrow batch: texts are long, and a Python worker holds a batch or two.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make a session ready: send the package to the executors, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="verbatim-llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove what ``stored`` wrote for these tables, once nothing reads them any more."""
    hadoop = spark._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def free_name(columns: Iterable[str], wish: str) -> str:
    """``wish``, with underscores in front while a column of that name exists (names compare without case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def words(text: Column) -> Column:
    """The words of a text as an array; none for null and for white space alone."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def pieces(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where any of the integer ``columns`` changes: (values, rows) of each piece, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(keys[:, start].tolist()), batch.slice(start, stop - start)
