"""Where models plug in.

* A scorer maps a text column to a score column.
* An encoder maps a text column to an array-of-numbers column.
* A pair scorer maps a text column and an array of candidate texts to an array of scores.

The built-ins are deterministic expressions. The adapters below wrap a model so that it is loaded once per Python worker
and called on batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from verbatim.functions.expr import bind
from verbatim.functions.sentiment import lexicon_probs

Scorer = Callable[[Column], Column]
Encoder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]


def overlap_pair_scorer() -> PairScorer:
    """Word overlap (Jaccard) of the text with each candidate.

    A batch of rows is scored at once: the word set of a candidate is made once a batch, that of a text once a row.
    """

    @F.arrow_udf("array<double>")
    def overlap(texts: pa.Array, candidates: pa.Array) -> pa.Array:
        lengths = candidates.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = candidates.flatten().fill_null("").dictionary_encode()
        # White space for ``split`` is the class that ``functions.patterns.WS`` spells out.
        sets = [set(c.split()) for c in coded.dictionary.to_pylist()]
        places = coded.indices.to_pylist()
        scores = np.zeros(len(places))
        at = 0
        for text, n in zip(texts.to_pylist(), lengths.tolist(), strict=True):
            own = set((text or "").split()) if n else ()
            for i in range(at, at + n) if own else ():
                other = sets[places[i]]
                if common := len(own & other):
                    scores[i] = common / (len(own) + len(other) - common)
            at += n
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(scores), mask=candidates.is_null())

    return lambda text, candidates: overlap(F.lower(text), F.transform(candidates, F.lower))


def lexicon_aspect_scorer() -> Callable[[Column, Column], Column]:
    """(text, aspect) -> ``struct<label, score>``: the most likely lexicon class of the text."""

    def score(text: Column, aspect: Column) -> Column:
        def best(p: Column) -> Column:
            top = F.greatest(p["neg"], p["neu"], p["pos"])
            label = F.when(p["neg"] == top, "Negative").when(p["neu"] == top, "Neutral").otherwise("Positive")
            return F.struct(label.alias("label"), top.alias("score"))

        return bind(lexicon_probs(text), best)

    return score


def model_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64) -> Scorer:
    """A batch model as a scorer. ``load`` runs once per worker and returns ``texts -> scores``."""

    def make_predict():
        model = load()
        return lambda texts: np.asarray(model(texts), dtype=np.float64)

    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    return lambda c: F.when(c.isNotNull(), predict(F.coalesce(c, F.lit(""))))


def model_list_scorer(load: Callable[[], Callable[[Sequence[str]], Sequence[float]]], batch_size: int = 64) -> Scorer:
    """A batch model over arrays of texts, such as the clauses of an answer: array of texts -> array of scores.

    All texts of an Arrow batch are scored together, equal ones once, and dealt back to their rows by the arrays' offsets.
    """

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for lists in batches:
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().fill_null("").dictionary_encode()
            texts, scores = coded.dictionary.to_pylist(), []
            for start in range(0, len(texts), batch_size):
                scores.extend(float(x) for x in model(texts[start:start + batch_size]))
            dealt = pa.array(scores, pa.float64()).take(coded.indices)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), dealt, mask=lists.is_null())

    return lambda texts: score(texts)


def model_encoder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 128) -> Encoder:
    """A batch model as an encoder. ``load`` returns ``texts -> matrix``."""

    def make_predict():
        model = load()
        return lambda texts: np.asarray(model(texts), dtype=np.float32)

    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return lambda c: F.when(c.isNotNull(), predict(F.coalesce(c, F.lit(""))))


def model_pair_scorer(
    load: Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[float]]], batch_size: int = 256
) -> PairScorer:
    """A batch model over (text, candidate) pairs. Candidates stay in their row, so nothing is regrouped."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = load()
        for texts, candidates in batches:
            lengths = np.asarray(candidates.value_lengths().fill_null(0), dtype=np.int64)
            own = np.repeat(np.arange(len(texts)), lengths)
            text_list, flat = texts.to_pylist(), candidates.flatten().to_pylist()
            pairs = [(text_list[i] or "", c or "") for i, c in zip(own, flat, strict=True)]
            scores: list[float] = []
            for start in range(0, len(pairs), batch_size):
                scores.extend(float(s) for s in model(pairs[start:start + batch_size]))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            mask = pa.array(np.asarray(candidates.is_null()))
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores, type=pa.float64()), mask=mask)

    return lambda text, candidates: score(text, candidates)
