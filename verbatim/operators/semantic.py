"""Theme assignment by vector similarity.

Each answer is compared with every phrase of its own text column. The phrase side is a matrix whose size is checked
before it is broadcast; one matrix product per Arrow batch gives all similarities of the batch, and only the best few per
answer leave the Python worker, so the (answer, phrase) pairs are never rows. A library beyond the limit is not collected: its
phrases meet the answers block by block, under bounds that rule most blocks out (``operators/blocked.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_once
from verbatim.functions.plugins import Encoder
from verbatim.operators import assignments as out
from verbatim.operators.blocked import add_blocked_candidates, best_columns
from verbatim.session import ship_package
from verbatim.settings import SemanticSettings

MAX_BROADCAST_BYTES = 256 * 1024 * 1024
_MAX_SCORES_PER_BLOCK = 4_000_000
# Similarities are rounded before ranking, so equal ones tie whatever order their terms were added in.
_RANK_DECIMALS = 10

PHRASE_COLUMNS = ["phrase_idx", "column", "parent", "theme", "subtheme", "polarity", "phrase", "vector"]

CANDIDATE_SCHEMA = (
    "array<struct<phrase_idx: int, theme: string, subtheme: string, parent_theme: string, score: double, "
    "polarity: string, matched_phrase: string>>"
)


@dataclass(frozen=True)
class PhraseMatrix:
    """Part of a phrase library on the driver: unit vectors and their labels."""

    columns: np.ndarray
    phrase_idx: np.ndarray
    polarity: np.ndarray
    labels: dict[str, list]
    vectors: np.ndarray

    @classmethod
    def collect(cls, library: DataFrame) -> PhraseMatrix:
        table = library.select(*PHRASE_COLUMNS).orderBy("phrase_idx").toArrow().combine_chunks()
        flat = [np.asarray(c.flatten(), dtype=np.float64) for c in table.column("vector").chunks]
        vectors = np.concatenate(flat).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))
        rows = table.drop_columns(["vector"]).to_pylist()
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        labels = {
            "theme": [r["theme"] for r in rows], "subtheme": [r["subtheme"] for r in rows],
            "parent_theme": [r["parent"] for r in rows], "polarity": [r["polarity"] for r in rows],
            "matched_phrase": [r["phrase"] for r in rows],
        }
        return cls(
            np.array([r["column"] for r in rows], dtype=object), np.array([r["phrase_idx"] for r in rows], np.int32),
            np.array([r["polarity"] for r in rows], dtype=object), labels, vectors,
        )


def encode_library(library: DataFrame, encoder: Encoder) -> DataFrame:
    """Add the phrase vectors to a flat library with ``phrase_idx``."""
    return library.withColumn("vector", encoder(F.col("phrase")))


def _top_candidates(
    vector: Column, text_column: Column, label: Column, matrix, threshold: float, top_k: int, weight: float
) -> Column:
    """Best phrases per row from a broadcast matrix."""

    @F.arrow_udf(CANDIDATE_SCHEMA)
    def match(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = matrix.value
        unit_vectors, polarity, phrase_idx = m["vectors"], m["polarity"], m["phrase_idx"]
        dim = unit_vectors.shape[1]
        by_column = {c: np.flatnonzero(m["columns"] == c) for c in set(m["columns"])}
        either, signed = polarity == "Either", np.isin(polarity, ["Positive", "Negative"])
        labels = {k: pa.array(v, type=pa.string()) for k, v in m["labels"].items()}
        for vectors, columns, sentiments in batches:
            n = len(vectors)
            valid = np.asarray(vectors.is_valid())
            rows_valid = np.flatnonzero(valid)
            data = np.zeros((n, dim))
            if rows_valid.size:
                flat = np.asarray(vectors.drop_null().flatten(), dtype=np.float64).reshape(rows_valid.size, -1)
                norms = np.linalg.norm(flat, axis=1, keepdims=True)
                data[rows_valid] = np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0)
            names = np.array(columns.to_pylist(), dtype=object)
            moods = np.array([s or "" for s in sentiments.to_pylist()], dtype=object)
            picked_row, picked_phrase, picked_score = [], [], []
            for name, phrases in by_column.items():
                rows = rows_valid[names[rows_valid] == name]
                step = max(1, _MAX_SCORES_PER_BLOCK // max(1, phrases.size))
                for start in range(0, rows.size, step):
                    block = rows[start:start + step]
                    scores = data[block] @ unit_vectors[phrases].T
                    if weight > 0:
                        mood = moods[block][:, None]
                        aligned = (mood != "") & (either[phrases] | (signed[phrases] & (polarity[phrases] == mood)))
                        scores = scores + weight * aligned
                    scores = np.round(scores, _RANK_DECIMALS)
                    best = best_columns(scores, top_k)
                    best_scores = np.take_along_axis(scores, best, axis=1)
                    keep = best_scores >= threshold
                    picked_row.append(np.repeat(block, keep.sum(axis=1)))
                    picked_phrase.append(phrases[best[keep]])
                    picked_score.append(best_scores[keep])
            row = np.concatenate(picked_row) if picked_row else np.zeros(0, np.int64)
            phrase = np.concatenate(picked_phrase) if picked_phrase else np.zeros(0, np.int64)
            score = np.concatenate(picked_score) if picked_score else np.zeros(0)
            order = np.argsort(row, kind="stable")
            phrase, score = phrase[order], score[order]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            take = pa.array(phrase)
            structs = pa.StructArray.from_arrays(
                [
                    pa.array(phrase_idx[phrase]), labels["theme"].take(take), labels["subtheme"].take(take),
                    labels["parent_theme"].take(take), pa.array(score), labels["polarity"].take(take),
                    labels["matched_phrase"].take(take),
                ],
                names=["phrase_idx", "theme", "subtheme", "parent_theme", "score", "polarity", "matched_phrase"],
            )
            yield pa.ListArray.from_arrays(pa.array(offsets), structs, mask=pa.array(~valid))

    return match(vector, text_column, label)


def add_candidates(
    df: DataFrame,
    library: DataFrame,
    threshold: float,
    top_k: int,
    sentiment_weight: float = 0.15,
    vector: str = "vector",
    label: str = "sentiment_label",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add ``candidates``: the best phrases of the row's text column at or above the threshold, best first.

    ``library`` has the columns in ``PHRASE_COLUMNS`` with ``phrase_idx`` counting from 0. Rows without a vector get null.
    """
    spark = df.sparkSession
    size = library.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    mood = F.col(label) if label in df.columns else F.lit(None).cast("string")

    def pick(part: DataFrame) -> Column:
        # Plain arrays, not the class: cheap to read in every worker.
        ship_package(spark)
        matrix = spark.sparkContext.broadcast(vars(PhraseMatrix.collect(part)))
        return _top_candidates(F.col(vector), F.col("TextColumn"), mood, matrix, threshold, top_k, sentiment_weight)

    if n * dim * 8 <= max(max_broadcast_bytes, dim * 8):
        return compute_once(df, "candidates", pick(library))
    return add_blocked_candidates(
        df, library, CANDIDATE_SCHEMA, threshold, top_k, sentiment_weight, vector, mood, n, len(known_columns(library)), dim,
        max_broadcast_bytes,
    )


def collapse_candidates(candidates: Column, method: str, score: str, delimiter: str) -> dict[str, Column]:
    """Candidate labels joined in rank order; the polarity is the best candidate's alone."""
    return {
        "theme": out.join_field(candidates, "theme", delimiter),
        "subtheme": out.join_field(candidates, "subtheme", delimiter),
        "parent_theme": out.join_field(candidates, "parent_theme", delimiter),
        "rule_score": out.mean_field(candidates, score),
        "expected_polarity": F.get(candidates, F.lit(0))["polarity"],
        "match_method": F.lit(method),
        "evidence": out.join_field(candidates, "matched_phrase", delimiter, skip_blank=True),
    }


def label_candidates(
    df: DataFrame, method: str, score: str, no_match: Column, delimiter: str, segment_rules: bool = False
) -> DataFrame:
    """Turn the ``candidates`` column into label columns."""
    detail = F.col("response_detail")
    dismissed = F.coalesce(~F.col("is_meaningful"), F.lit(False))
    has_detail = F.coalesce(detail != "", F.lit(False))
    reason = F.lit("dismissed")
    if not segment_rules:
        reason = F.when(has_detail, F.concat(F.lit("dismissed:"), detail)).otherwise("dismissed")
    candidates = F.coalesce(F.col("candidates"), F.array().cast(df.schema["candidates"].dataType))
    return out.labels(
        df, collapse_candidates(candidates, method, score, delimiter), candidates, dismissed, no_match,
        F.when(has_detail, detail).otherwise("No"), reason,
    ).drop("candidates")


def known_columns(library: DataFrame, max_columns: int = 10_000) -> list[str]:
    """Text columns the library has phrases for."""
    names = [r[0] for r in library.select("column").distinct().limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"a library serves at most {max_columns} text columns")
    return names


def with_vectors(df: DataFrame, encoder: Encoder | None, vector: str = "vector") -> DataFrame:
    """Encode the answers that are not dismissed; with no encoder, the vectors are already there."""
    if encoder is None:
        return df
    active = F.coalesce(F.col("is_meaningful"), F.lit(True))
    return df.withColumn(vector, encoder(F.when(active, F.coalesce(F.col("text"), F.lit("")))))


def assign_semantic(
    long: DataFrame,
    library: DataFrame,
    encoder: Encoder | None = None,
    settings: SemanticSettings = SemanticSettings(),
) -> DataFrame:
    """The semantic assignment table, one row per (``ID``, ``TextColumn``)."""
    matched = add_candidates(
        with_vectors(long, encoder), library, settings.similarity_threshold, settings.top_k, settings.sentiment_weight
    )
    no_match = F.when(F.col("TextColumn").isin(*known_columns(library)), "below_threshold").otherwise(
        "no_phrases_for_column"
    )
    labelled = label_candidates(matched, "semantic_similarity", "score", no_match, settings.delimiter)
    return labelled.withColumn("is_meaningful", F.coalesce(F.col("is_meaningful"), F.lit(True))).select(*out.COLUMNS)
