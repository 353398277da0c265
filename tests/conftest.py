import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from verbatim.session import local_session

    return local_session(4, shuffle_partitions=4, app="verbatim-tests")


@pytest.fixture()
def values(spark):
    """Evaluate a column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("v"))
        return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return run


def brief(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
