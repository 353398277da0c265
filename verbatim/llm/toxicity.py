"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is a bag of the character n-grams of ``<word>`` and the word itself; each has a vector in a hashed table, so a
misspelling or a form never seen shares most of its vectors with the known one. The vectors of a window of words are averaged
and go through a two-class softmax; vectors and softmax are trained jointly, in numpy, on the driver, on a bounded sample of
labelled documents. A label says that a document holds something toxic somewhere, so the windows to train on are chosen
again in each epoch: of a toxic document its worst window, of a clean one its worst and a random one.

A document's score is the probability of its worst window; windows cover the whole text, however long, so a few words in
a very long text weigh as much as in a short one. The model is linear after the embedding, so scoring needs one number per
distinct word. The model has a fixed size (``buckets * dim`` floats) and is broadcast.

Defined results: null, empty and blank texts score 0; labels other than 0 and 1 and labels of unknown documents are not
used, repeated labels count once (the larger); of a sampled id with several texts the least is learnt from; with no label of either class everything scores 0. Repeated rows score
alike; other columns are left alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words whose odds a worker keeps, about 160 bytes each: workers outlive a stage, and what they keep stands beside the next one.
REMEMBERED = 100_000
#: Parts in which the sampled texts come to the driver.
SAMPLE_PARTS = 16


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the training documents per class, whatever the number of labels."""

    buckets: int = 1 << 20
    dim: int = 4
    n_min: int = 3
    n_max: int = 6
    window: int = 8
    sample: int = 4000
    steps: int = 1600
    warm_steps: int = 500
    batch: int = 128
    rate: float = 0.3
    seed: int = 7
    threshold: float = 0.3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def subwords(words: list[bytes], s: Settings):
    """Bucket ids of the n-grams of all words, one word after the other, and each word's first place."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(text) != sizes.sum():
        raise ValueError("a word changed its length on the way")
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    place = np.arange(len(text))
    word = np.repeat(np.arange(len(words)), sizes)
    prime = np.uint64(0x100000001B3)
    # The whole word first: a polynomial over its characters.
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), prime, np.uint64))
    whole = np.add.reduceat(text * powers[place - np.repeat(starts, sizes)], starts) if len(words) else np.empty(0, np.uint64)
    owners, hashes = [np.arange(len(words))], [whole + np.uint64(1)]
    h = np.zeros(len(text), np.uint64)
    for n in range(1, s.n_max + 1):
        reach = len(text) - n + 1
        if reach <= 0:
            break
        h = h[:reach] * prime + text[n - 1 :]
        if n >= s.n_min:
            inside = place[:reach] + n <= ends[:reach]
            owners.append(word[:reach][inside])
            hashes.append(h[inside] * np.uint64(2 * n + 1))
    owner, flat = np.concatenate(owners), np.concatenate(hashes)
    flat = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return ((flat >> np.uint64(40)) % np.uint64(s.buckets)).astype(np.int32)[order], np.cumsum(counts) - counts


def all_subwords(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the n-grams of many words, and their number per word; in parts, to hold little at a time."""
    flat, counts = array("i"), []
    for i in range(0, len(words), 20_000):
        part, at = subwords(words[i : i + 20_000], s)
        flat.frombytes(part.tobytes())
        counts.append(np.diff(np.append(at, len(part))))
    return np.frombuffer(flat, np.int32), np.concatenate(counts).astype(np.int64)


def window_starts(n: int, size: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words; the last window takes the remainder."""
    return np.arange(0, max(n - size, 0) + 1, size) if n else np.empty(0, np.int64)


@dataclass
class Model:
    """``vectors`` (buckets x dim), softmax ``weights`` (2 x dim) and ``bias`` (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def slopes(self) -> np.ndarray:
        """What each bucket adds to the log odds of a window that consists of it."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


@dataclass
class Sample:
    """The training texts as word numbers, window after window; a word counts once in a window.

    ``tokens`` of window i are the ``w_count[i]`` after those of the windows before; ``w_size`` is the window's size with
    repeated words.
    """

    index: dict[bytes, int]
    labels: np.ndarray
    tokens: np.ndarray
    w_doc: np.ndarray
    w_size: np.ndarray
    w_count: np.ndarray


def indexed(pairs: Iterable[tuple[str | None, int]], s: Settings) -> Sample | None:
    """Read the texts a few at a time and keep their word numbers only; None if a class is missing."""
    index: dict[bytes, int] = {}
    seen, labels, tokens, sizes, counts, windows = set(), [], [], [], [], []
    pairs = iter(pairs)
    while part := list(islice(pairs, 256)):
        docs = []
        for text, label in part:
            seen.add(label)
            if words := words_of(text):
                labels.append(label)
                docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
        if not docs:
            continue
        flat = np.concatenate(docs)
        starts = [window_starts(len(d), s.window) for d in docs]
        first = np.concatenate([w + f for w, f in zip(starts, np.cumsum([0] + [len(d) for d in docs]), strict=False)])
        size = np.append(first[1:], len(flat)) - first
        window = np.repeat(np.arange(len(size)), size)
        _, once = np.unique((window << 32) + flat, return_index=True)
        once.sort()
        tokens.append(flat[once])
        sizes.append(size.astype(np.int32))
        counts.append(np.bincount(window[once], minlength=len(size)).astype(np.int32))
        windows += [len(w) for w in starts]
    if seen != {0, 1} or not tokens:
        return None
    w_doc = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    return Sample(index, np.array(labels), *[np.concatenate(x) if isinstance(x, list) else x for x in (tokens, w_doc, sizes, counts)])


def train(pairs: Iterable[tuple[str | None, int]], s: Settings) -> Model | None:
    """Joint training by Adagrad on windows of (text, label); None if a class is missing."""
    sample = indexed(pairs, s)
    if sample is None:
        return None
    rng = np.random.default_rng(s.seed)
    y_all, tokens, w_doc, w_size = sample.labels, sample.tokens, sample.w_doc, sample.w_size
    flat, count = all_subwords(list(sample.index), s)
    sample.index.clear()
    at = np.cumsum(count) - count
    w_last = np.cumsum(sample.w_count, dtype=np.int64)
    w_first = w_last - sample.w_count
    docs = len(y_all)
    d_first = np.searchsorted(w_doc, np.arange(docs))
    d_count = np.bincount(w_doc, minlength=docs)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    weights = rng.uniform(-0.5, 0.5, (2, s.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full_like(p, 1e-6) for p in (vectors, weights, bias)]
    share = np.bincount(y_all, minlength=2) / len(y_all)

    step = 0
    while step < s.steps:
        random = d_first + rng.integers(0, d_count)
        if step < s.warm_steps:
            chosen = random
        else:
            slope = vectors @ (weights[1] - weights[0])
            word_odds = np.add.reduceat(slope[flat], at) / count
            odds = np.add.reduceat(word_odds[tokens], w_first) / w_size
            order = np.lexsort((odds, w_doc))
            worst = order[np.append(d_first[1:], len(w_doc)) - 1]
            chosen = np.concatenate([worst, random[y_all == 0]])
        chosen = rng.permutation(chosen)
        for b in range(0, len(chosen), s.batch):
            rows = chosen[b : b + s.batch]
            step += 1
            size = w_last[rows] - w_first[rows]
            token_row = np.repeat(np.arange(len(rows)), size)
            token = tokens[np.repeat(w_first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            grams = count[token]
            gram = flat[np.repeat(at[token], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)]
            gram_row = np.repeat(token_row, grams)
            weight = np.repeat((1 / (w_size[rows][token_row] * grams)).astype(np.float32), grams)
            starts = np.searchsorted(gram_row, np.arange(len(rows)))
            mean = np.add.reduceat(vectors[gram] * weight[:, None], starts, axis=0)
            logits = mean @ weights.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = y_all[w_doc[rows]]
            p[np.arange(len(rows)), y] -= 1
            p *= (0.5 / share[y])[:, None] / len(rows)
            g_mean = p @ weights
            touched, back = np.unique(gram, return_inverse=True)
            g_vectors = np.stack([np.bincount(back, g_mean[gram_row, k] * weight) for k in range(s.dim)], axis=1).astype(np.float32)
            for param, square, where, grad in (
                (vectors, squares[0], touched, g_vectors),
                (weights, squares[1], slice(None), p.T @ mean),
                (bias, squares[2], slice(None), p.sum(axis=0)),
            ):
                square[where] += grad * grad
                param[where] -= s.rate * grad / np.sqrt(square[where])
    return Model(vectors, weights, bias)


class WordOdds(dict):
    """What a distinct word adds to the log odds of its window."""

    def __init__(self, slopes: np.ndarray, s: Settings):
        super().__init__()
        self.slopes, self.settings = slopes, s

    def learn(self, words: list[bytes]) -> None:
        """Look up new words together; forget all when full."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            flat, first = subwords(part, self.settings)
            count = np.diff(np.append(first, len(flat)))
            self.update(zip(part, (np.add.reduceat(self.slopes[flat], first) / count).tolist(), strict=True))


def worst_mean(value: np.ndarray, size: int) -> float:
    """The largest mean over the windows of a text; equal values in a window are one word."""
    last = window_starts(len(value), size)[-1]
    tail = value[last:]
    worst = np.unique(tail).sum() / len(tail)
    if last:
        rows = np.sort(value[:last].reshape(-1, size), axis=1)
        again = rows[:, 1:] == rows[:, :-1]
        rows[:, 1:][again] = 0
        worst = max(worst, rows.sum(axis=1).max() / size)
    return worst


def score_texts(texts: list[str | None], slopes: np.ndarray, offset: float, s: Settings, odds: WordOdds) -> np.ndarray:
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 64):
        lists = [words_of(t) for t in texts[at : at + 64]]
        odds.learn([w for words in lists for w in words])
        for i, words in enumerate(lists, at):
            if words:
                value = np.fromiter(map(odds.__getitem__, words), np.float64, len(words))
                out[i] = 1 / (1 + np.exp(-np.clip(worst_mean(value, s.window) + offset, -500, 500)))
    return out


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings, key: str, text: str, label: str) -> DataFrame:
    """``text, label`` of about ``sample`` documents of each class at most, chosen by a hash of the id.

    The numbers of labels give the share to take; only the chosen ids are broadcast, at most about twice ``sample``.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.col("id").cast("string")), F.lit(1_000_000))
    part = F.lit(0)
    for y, n in sizes.items():
        part = F.when(F.col("y") == y, F.lit(min(1_000_000, 1_000_000 * s.sample // n))).otherwise(part)
    chosen = known.filter(draw < part)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Train on the sample, whose texts come to the driver a part at a time and are dropped once their words are numbered."""
    s = s or Settings()
    rows = training_sample(docs, labels, s, key, text, label)
    ordered = rows.repartitionByRange(SAMPLE_PARTS, "id").sortWithinPartitions("id")
    return train(((r["text"], r["y"]) for r in ordered.select("text", "y").toLocalIterator()), s)


def score(text: Column, model: Model | None, spark, s: Settings | None = None) -> Column:
    """The probability, 0 to 1, that a text holds something toxic."""
    s = s or Settings()
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast((model.slopes(), model.offset()))

    @F.arrow_udf("double")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slopes, offset = shared.value
        odds = worker_odds(slopes.tobytes(), s)
        for batch in texts:
            yield pa.array(score_texts(batch.to_pylist(), slopes, offset, s, odds), pa.float64())

    return toxic(text)


@lru_cache(maxsize=1)
def worker_odds(slopes: bytes, s: Settings) -> WordOdds:
    """One per Python worker and model."""
    return WordOdds(np.frombuffer(slopes, np.float32), s)
