"""Small configuration documents, through the file systems Spark knows, so that a path means the same to all of it."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def read_text(path: str, missing_ok: bool = False) -> str | None:
    """A whole document; without a session, from the local disk."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        file = Path(path)
        return None if missing_ok and not file.exists() else file.read_text(encoding="utf-8")
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row["value"] if row else ""


def write_text(text: str, path: str) -> None:
    """Write a whole document; without a session, to the local disk."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_yaml(path: str, missing_ok: bool = False) -> dict[str, Any]:
    """Parse a YAML document, or a JSON document where no YAML parser is installed."""
    text = read_text(path, missing_ok)
    if text is None:
        return {}
    try:
        import yaml
    except ImportError:
        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


def write_yaml(data: Any, path: str) -> None:
    """Write YAML, or JSON (which YAML readers accept) where no YAML writer is installed."""
    try:
        import yaml
    except ImportError:
        text = json.dumps(data, indent=2, ensure_ascii=False)
    else:
        text = yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
    write_text(text, path)
