"""Several labels per row, learned from vectors and judged on rows that took no part.

All labels are one-against-the-rest logistic models trained together: a round adds up one gradient, labels by components, in the
tasks, and only that sum comes to the driver. Rows are split by a hash of their key: most train, some choose each label's
threshold, the rest are held out for the table of precision and recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.session import ensure_checkpoint_dir, ship_package

FOLDS = 10
HELD_OUT = (0, 1)
CHOOSING = (2, 3)
# A threshold is a multiple of 1 / STEPS.
STEPS = 20


@dataclass(frozen=True)
class LabelModel:
    """Weights per label, the last one for the constant, and the threshold chosen for each label, in steps."""

    labels: list[str]
    weights: np.ndarray
    thresholds: dict[str, int] = field(default_factory=dict)


def fold_of(key: Column) -> Column:
    """The fold of a row, 0 to 9, by the hash of its key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS


def _with_constant(lists: pa.Array) -> np.ndarray:
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _truth(lists: pa.Array, labels: list[str]) -> np.ndarray:
    """1 where a row carries a label; null and unknown labels count for nothing."""
    out = np.zeros((len(lists), len(labels)))
    row = np.asarray(pc.list_parent_indices(lists))
    label = pc.index_in(lists.flatten(), pa.array(labels, pa.string())).to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(label)
    out[row[known], label[known].astype(int)] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_labels(df: DataFrame, vector: str, labels: str, rounds: int = 40, max_labels: int = 2_000) -> LabelModel:
    """Train on all rows of ``df`` with a vector; ``labels`` is an array of strings, null for none.

    The step is 4 over the mean squared length of a vector, below the bound from which a round could overshoot. Labels are what
    the driver holds, so their number is bounded; without rows or labels the model is empty.
    """
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = df.filter(F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("v"), F.coalesce(labels, F.array().cast("array<string>")).alias("l")
    ).checkpoint()
    length = F.aggregate("v", F.lit(1.0), lambda a, x: a + x * x)
    n, dim, mean = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.avg(length)).first()
    names = rows.select(F.explode("l").alias("l")).filter("l IS NOT NULL").distinct().orderBy("l").limit(max_labels + 1).collect()
    if len(names) > max_labels:
        raise ValueError(f"a model takes at most {max_labels} labels")
    names = [r["l"] for r in names]
    if not names:
        return LabelModel([], np.zeros((0, (dim or 0) + 1)))
    weights = np.zeros((len(names), dim + 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                x = _with_constant(batch.column(0))
                total += (_sigmoid(x @ shared.value.T) - _truth(batch.column(1), names)).T @ x
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()[i])], ["i", "x"])

        summed = rows.mapInArrow(gradient, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        step = np.zeros(weights.size)
        step[summed.column("i").to_numpy()] = summed.column("x").to_numpy()
        weights = weights - 4.0 / mean / n * step.reshape(weights.shape)
        shared.unpersist()
    return LabelModel(names, weights)


def add_label_scores(df: DataFrame, model: LabelModel, vector: str, name: str = "label_scores") -> DataFrame:
    """Add an array of (label, score), in the order of the model's labels; null without a vector."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.labels, model.weights))

    @F.arrow_udf("array<struct<label: string, score: double>>")
    def scored(lists: pa.Array) -> pa.Array:
        labels, weights = shared.value
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        scores = np.zeros((0, len(labels)))
        if there.any():
            scores = _sigmoid(_with_constant(lists.drop_null()) @ weights.T)
        structs = pa.StructArray.from_arrays(
            [pa.array(labels * len(scores), pa.string()), pa.array(scores.ravel())], names=["label", "score"]
        )
        ends = np.concatenate([[0], np.cumsum(there) * len(labels)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), structs, mask=pa.array(~there))

    return df.withColumn(name, scored(F.col(vector).cast("array<double>")))


def _confusion(scored: DataFrame, labels: str, part: Column, scores: str) -> DataFrame:
    """Rows per part, label and threshold step: tp, fp, fn. Rows are counted by score step before anything is shuffled."""
    own = F.coalesce(labels, F.array().cast("array<string>"))
    each = scored.select(part.alias("part"), own.alias("own"), F.explode(scores).alias("s"))
    counts = each.groupBy(
        "part", F.col("s.label").alias("label"), F.least(F.floor(F.col("s.score") * STEPS), F.lit(STEPS - 1)).alias("at"),
        F.coalesce(F.array_contains("own", F.col("s.label")), F.lit(False)).alias("is"),
    ).agg(F.count(F.lit(1)).alias("n"))
    steps = counts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS - 1))))
    said, true = F.col("at") >= F.col("step"), F.col("is")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return steps.groupBy("part", "label", "step").agg(
        count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn")
    )


def judge_labels(df: DataFrame, model: LabelModel, key: str, vector: str, labels: str) -> DataFrame:
    """Threshold and held-out precision, recall and F1 per label.

    The threshold is the step with the best F1 on the choosing folds, of equally good ones the nearest to a half, then the
    lowest. A measure without cases is null.
    """
    part = F.when(fold_of(F.col(key)).isin(*HELD_OUT), "held").when(fold_of(F.col(key)).isin(*CHOOSING), "choose")
    table = _confusion(add_label_scores(df.filter(part.isNotNull()), model, vector, "_scores"), labels, part, "_scores")
    table = table.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    order = Window.partitionBy("label").orderBy(
        F.desc(F.round(F.coalesce("f1", F.lit(0.0)), 12)), F.abs(F.col("step") - STEPS // 2), "step"
    )
    chosen = table.filter("part = 'choose'").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("label", "step")
    return table.filter("part = 'held'").join(chosen, ["label", "step"]).select(
        "label", (F.col("step") / STEPS).alias("threshold"), "tp", "fp", "fn",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), "f1",
    )


def train_and_judge(
    df: DataFrame, key: str, vector: str, labels: str, rounds: int = 40
) -> tuple[LabelModel, DataFrame]:
    """The model trained on the training folds, with its thresholds, and the table of ``judge_labels`` (written once)."""
    aside = fold_of(F.col(key)).isin(*HELD_OUT, *CHOOSING)
    model = fit_labels(df.filter(~aside), vector, labels, rounds)
    table = judge_labels(df, model, key, vector, labels).checkpoint()
    steps = {r["label"]: round(r["threshold"] * STEPS) for r in table.select("label", "threshold").collect()}
    return LabelModel(model.labels, model.weights, steps), table


def predict_labels(df: DataFrame, model: LabelModel, vector: str, name: str = "predicted_labels") -> DataFrame:
    """Add the labels whose score reaches their threshold (a half where none was chosen); null without a vector."""
    steps = F.array(*[F.lit(model.thresholds.get(label, STEPS // 2)) for label in model.labels])
    scored = add_label_scores(df, model, vector, "_scores")
    reached = F.filter(F.col("_scores"), lambda s, i: F.least(F.floor(s["score"] * STEPS), F.lit(STEPS - 1)) >= F.get(steps, i))
    return scored.withColumn(name, F.transform(reached, lambda s: s["label"])).drop("_scores")
