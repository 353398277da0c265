"""Fuzzy keyword matching as joins of word windows and keywords.

A keyword of a list (a slot) matches a text fuzzily if the text holds it as a substring (1.0), if a window of as many words
reaches the Ratcliff-Obershelp ratio ``threshold`` (the first such window counts), if each of its words contains or is contained
in some word of the text (0.80), or if the best window is at most 0.05 below the threshold. Each distinct text is matched once:

* Windows become rows and meet the keywords of as many words on their length. The join condition compares letter counts, kept
  as bit masks: a ratio cannot exceed what the letters two strings share allow. That bound is exact and a few machine
  instructions per pair; of random pairs it leaves one or two in a hundred.
* For these pairs the longest common subsequence, a tighter bound, is computed for a batch at once, and the ratio itself only
  where that reaches the floor.
* Substrings and related words come from one pass of an automaton over the text, whose cost does not grow with the number of
  keywords; related words then meet the keywords by a join and a count.

Texts are dealt once, by their hash; everything up to the best match per slot happens there. Matches go back to the rows by that hash. As texts are collapsed first, this does not run on a stream; micro-batches are matched one by one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_all, explode_rows
from verbatim.functions.text import match_normalise
from verbatim.session import ensure_checkpoint_dir, ship_package

FUZZY_SCHEMA = "array<struct<slot: int, score: double, evidence: string>>"
SCATTERED_SCORE = 0.80
#: How far below the threshold the best window still counts.
SLACK = 0.05
#: Keywords in one broadcast table; a larger library is dealt into lots that are joined by shuffle.
BROADCAST_KEYWORDS = 50_000
#: Characters of the terms in one automaton; a larger library takes several passes, one after the other.
AUTOMATON_CHARS = 4_000_000
#: Words whose windows are made at a time: a window takes a row of counts, so a batch of long texts is cut to bound the memory.
WINDOW_WORDS = 20_000
#: Letters counted on their own in the bound; all other characters count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz "
_SPACE, _CLASSES, _HALF, _CAP = LETTERS.index(" "), len(LETTERS) + 1, 14, 4
#: The class of each byte of UTF-8; bytes that continue a character belong to none.
_BYTE_CLASS = np.array([LETTERS.find(chr(b)) if chr(b) in LETTERS else _CLASSES if 128 <= b < 192 else _CLASSES - 1 for b in range(256)])
_WINDOW_FIELDS = [("width", pa.int32()), ("pos", pa.int32()), ("win", pa.string()), ("m1", pa.int64()), ("m2", pa.int64()), ("over", pa.int32()), ("len", pa.int32())]
_WINDOW_TYPE = pa.list_(pa.struct(_WINDOW_FIELDS))
_WINDOW_SCHEMA = "array<struct<width: int, pos: int, win: string, m1: bigint, m2: bigint, over: int, len: int>>"


@dataclass(frozen=True)
class FuzzySlot:
    """One list of keywords whose best fuzzy match is wanted, in list order."""

    slot: int
    keywords: tuple[str, ...]


# ---- substrings and related words ----------------------------------------------------------------------------------


class Automaton:
    """All terms that occur in a text as substrings, found in one pass over it (Aho and Corasick)."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, term in enumerate(terms):
            node = 0
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    ends.append([])
                node = self.next[node][ch]
            if node:
                ends[node].append(i)
        self.fail = [0] * len(self.next)
        #: The terms that end at a node, and the nearest shorter suffix at which others do.
        self.ends, self.shorter = ends, [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for ch, child in self.next[node].items():
                queue.append(child)
                back = self.fail[node]
                while back and ch not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = back = self.next[back].get(ch, 0)
                self.shorter[child] = back if ends[back] else self.shorter[back]

    def found(self, text: str) -> list[int]:
        """Numbers of the terms in the text, each once, ascending."""
        step, fail, ends, shorter = self.next, self.fail, self.ends, self.shorter
        seen, node = set(), 0
        for ch in text:
            while node and ch not in step[node]:
                node = fail[node]
            node = step[node].get(ch, 0)
            at = node if ends[node] else shorter[node]
            # A node that was met before has brought its shorter ones along.
            while at and at not in seen:
                seen.add(at)
                at = shorter[at]
        return sorted(i for at in seen for i in ends[at])


def term_parts(terms: list[str], chars: int = AUTOMATON_CHARS) -> list[range]:
    """Runs of terms that fit one automaton each."""
    cuts, size = [0], 0
    for i, term in enumerate(terms):
        if size and size + len(term) > chars:
            cuts.append(i)
            size = 0
        size += len(term)
    return [range(a, b) for a, b in zip(cuts, [*cuts[1:], len(terms)], strict=True) if a < b]


@lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    """One per Python worker: the part in use."""
    return Automaton(list(terms))


def held_terms(text: Column, terms: list[str], first: int = 0) -> Column:
    """Numbers, from ``first``, of the terms that a normalised text contains; array<int>."""
    spark = SparkSession.active()
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tuple(terms))

    @F.arrow_udf("array<int>")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(shared.value)
        for texts in batches:
            lists = [[first + i for i in automaton.found(t)] if t else [] for t in texts.to_pylist()]
            yield pa.array(lists, pa.list_(pa.int32()))

    return held(text)


def held_rows(texts: DataFrame, keep: list[str], text: str, terms: list[str], name: str = "term") -> DataFrame:
    """A row per text and term that it contains: ``keep`` and the term's number. Large libraries take a pass a part."""
    parts = term_parts(terms)
    if not parts:
        return texts.select(*keep, F.lit(0).alias(name)).filter(F.lit(False))
    found = None
    for part in parts:
        hits = texts.select(*keep, held_terms(F.col(text), [terms[i] for i in part], part.start).alias("_held"))
        rows = explode_rows(hits, keep, F.col("_held"), name)
        found = rows if found is None else found.unionByName(rows)
    return found


def containing_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(word, term): every substring of every term, to find the words that a term contains."""
    rows = spark.createDataFrame(list(enumerate(terms)), "term int, t string")
    size = F.length("t")
    starts = F.sequence(F.lit(1), size)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("t", i, n))))
    return rows.filter("t <> ''").select("term", F.explode(F.array_distinct(parts)).alias("word"))


# ---- window ratios -------------------------------------------------------------------------------------------------


def letter_masks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``m1``, ``m2``: per class of letters as many bits as it occurs, four at most; ``over``: occurrences beyond.

    The letters two strings share are at most the common bits plus the smaller ``over``.
    """
    capped = np.minimum(counts, _CAP)
    unary = np.array([0, 1, 3, 7, 15], np.int64)[capped]
    shifts = _CAP * np.arange(_HALF)
    halves = [(unary[:, at : at + _HALF] << shifts[: unary[:, at : at + _HALF].shape[1]]).sum(axis=1) for at in (0, _HALF)]
    return halves[0], halves[1], (counts.sum(axis=1) - capped.sum(axis=1)).astype(np.int32)


def letter_counts(words: pa.Array) -> np.ndarray:
    """Per word its characters by class: each of ``LETTERS``, and all others together."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    kinds = _BYTE_CLASS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    counts = np.bincount(owner * (_CLASSES + 1) + kinds, minlength=len(words) * (_CLASSES + 1))
    return counts.reshape(len(words), _CLASSES + 1)[:, :_CLASSES]


def windows_of(words: pa.ListArray, widths: list[int]) -> pa.ListArray:
    """The windows of each text's words, with their letter masks."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    counts = letter_counts(flat) if len(flat) else np.zeros((0, _CLASSES), np.int64)
    rows, columns = [], []
    for width in widths:
        n = len(flat) - width + 1
        if n < 1:
            continue
        whole = np.flatnonzero(row[:n] == row[width - 1 :])
        windows, sums = flat.slice(0, n), counts[:n].copy()
        for i in range(1, width):
            windows = pc.binary_join_element_wise(windows, flat.slice(i, n), " ")
            sums += counts[i : i + n]
        sums[:, _SPACE] += width - 1
        sums = sums[whole]
        rows.append(row[whole])
        columns.append((np.full(len(whole), width, np.int32), place[whole].astype(np.int32), windows.take(pa.array(whole)), *letter_masks(sums), sums.sum(axis=1).astype(np.int32)))
    if not rows:
        return pa.array([[] for _ in range(len(words))], _WINDOW_TYPE)
    owner = np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    parts = [pa.concat_arrays([pa.array(c[i]) if isinstance(c[i], np.ndarray) else c[i] for c in columns]).take(pa.array(order)) for i in range(len(columns[0]))]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_WINDOW_TYPE.value_type)))


def common_subsequence(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest common subsequence of pairs of strings, the first of ``sizes`` characters, 64 at most.

    ``places``: a row per pair and a column per character of the second string; bit i says that the first string has that
    character at i. A bit of the state turns to zero at each place up to which the subsequence has grown by one.
    """
    state = np.full(len(places), ~np.uint64(0))
    for at in places.T:
        met = state & at
        state = (state + met) | (state - met)
    low = np.where(sizes >= 64, ~np.uint64(0), (np.uint64(1) << (sizes % 64).astype(np.uint64)) - np.uint64(1))
    return sizes - np.bitwise_count(state & low).astype(np.int64)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of characters per text, filled up with zeros, and the sizes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _common(keywords: list[str], windows: list[str]) -> np.ndarray:
    number = {k: i for i, k in enumerate(dict.fromkeys(keywords))}
    a, a_size = _characters(list(number))
    b, _ = _characters(windows)
    alphabet, codes = np.unique(b, return_inverse=True)
    codes = codes.reshape(b.shape)
    # Bit i of table[k, c]: keyword k has character c at i. The filling is no character of a keyword.
    table = np.zeros((len(a), len(alphabet)), np.uint64)
    for i in range(a.shape[1]):
        at = np.minimum(np.searchsorted(alphabet, a[:, i]), len(alphabet) - 1)
        here = (alphabet[at] == a[:, i]) & (a[:, i] != 0)
        table[np.flatnonzero(here), at[here]] |= np.uint64(1) << np.uint64(i)
    which = np.fromiter(map(number.__getitem__, keywords), np.int64, len(keywords))
    return common_subsequence(table[which[:, None], codes], a_size[which])


def ratios(keywords: list[str], windows: list[str], floor: float) -> list[float | None]:
    """The ratio of each pair, None where it is below ``floor``."""
    out: list[float | None] = [None] * len(keywords)
    order = sorted(range(len(keywords)), key=lambda i: len(windows[i]))
    for at in range(0, len(order), 8192):
        part = [i for i in order[at : at + 8192] if keywords[i] and windows[i]]
        short = [i for i in part if len(keywords[i]) <= 64]
        worth = [i for i in part if len(keywords[i]) > 64]
        if short:
            common = _common([keywords[i] for i in short], [windows[i] for i in short])
            sizes = np.array([len(keywords[i]) + len(windows[i]) for i in short])
            worth += np.array(short)[2 * common >= floor * sizes - 1e-9].tolist()
        for i in worth:
            ratio = SequenceMatcher(None, keywords[i], windows[i]).ratio()
            if ratio >= floor:
                out[i] = ratio
    return out


def sequence_ratio(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Ratcliff-Obershelp similarity of two strings, null below ``floor``; equal pairs of a batch are compared once."""
    ship_package(SparkSession.active())

    @F.arrow_udf("double")
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = list(zip(left.to_pylist(), right.to_pylist(), strict=True))
        distinct = [p for p in dict.fromkeys(pairs) if None not in p]
        if floor > 0:
            found = dict(zip(distinct, ratios([p[0] for p in distinct], [p[1] for p in distinct], floor), strict=True))
        else:
            found = {p: SequenceMatcher(None, *p).ratio() for p in distinct}
        return pa.array([found.get(p) for p in pairs], pa.float64())

    return ratio(a, b)


def word_runs(lists: pa.ListArray, most: int) -> Iterator[pa.ListArray]:
    """The word lists cut into runs of ``most`` words; a list that is longer is a run of its own."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(lists):
        before = ends[start] - sizes[start]
        stop = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
        yield lists.slice(start, stop - start)
        start = stop


def word_windows(words: Column, widths: list[int]) -> Column:
    """The windows of as many words, with their letter masks; an array."""

    @F.arrow_udf(_WINDOW_SCHEMA)
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for part in word_runs(lists, WINDOW_WORDS):
                yield windows_of(part, widths)

    return windows(words)


def close_windows(texts: DataFrame, keep: list[str], words: str, keywords: list[tuple[int, str]], floor: float) -> DataFrame:
    """``keep``, kw, pos, win, ratio: the windows that reach ``floor`` with a keyword (kw, normalised) of as many words."""
    spark = texts.sparkSession
    lots = -(-len(keywords) // BROADCAST_KEYWORDS)
    widths = sorted({len(norm.split()) for _, norm in keywords})
    terms = spark.createDataFrame(keywords, "kw int, norm string").withColumn("words", F.split("norm", " "))
    own = F.filter(word_windows(F.col("words"), widths), lambda w: w["width"] == F.size("words"))
    terms = compute_all(terms, {"own": own}).select("kw", "norm", F.col("own")[0].alias("k"))
    # The lengths that two strings of this ratio can have.
    low = F.ceil(F.col("k.len") * F.lit(floor / (2 - floor)) - 1e-9)
    high = F.floor(F.col("k.len") * F.lit((2 - floor) / floor) + 1e-9)
    terms = terms.select("kw", "norm", "k.width", *[F.col(f"k.{n}").alias(f"k_{n}") for n in ("m1", "m2", "over", "len")], F.pmod(F.xxhash64("norm"), F.lit(lots)).cast("int").alias("lot"), F.explode(F.sequence(low, high).cast("array<int>")).alias("len"))
    met = explode_rows(texts.select(*keep, word_windows(F.col(words), widths).alias("_all")), keep, F.col("_all"), "_w").select(*keep, "_w.*")
    if lots > 1:
        met = met.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).join(terms, ["width", "len", "lot"])
    else:
        met = met.join(F.broadcast(terms.drop("lot")), ["width", "len"])
    bits = lambda m: F.bit_count(F.col(m).bitwiseAND(F.col(f"k_{m}")))
    common = bits("m1") + bits("m2") + F.least("over", "k_over")
    met = met.filter(2 * common >= F.lit(floor) * (F.col("len") + F.col("k_len")) - 1e-9)
    # Behind a generator the filter does not ask for the ratio a second time.
    ratio = F.array(F.struct(sequence_ratio(F.col("norm"), F.col("win"), floor).alias("ratio")))
    return met.select(*keep, "kw", "pos", "win", F.inline(ratio)).filter(F.col("ratio").isNotNull())


# ---- matching ------------------------------------------------------------------------------------------------------

ID = ["t1", "t2"]


def text_id(text: Column) -> list[Column]:
    """128 bits that stand for a text; null for null."""
    return [F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit("text"), text))]


def keyword_evidence(texts: DataFrame, keep: list[str], text: str, norms: list[str]) -> DataFrame:
    """``keep``, kw, word_no: what speaks for the keywords, numbered as in ``norms``, in normalised texts.

    A null ``word_no`` says that the text contains the keyword; a number, that the keyword's word of that number contains
    or is contained in some word of the text (keywords of several words only).
    """
    spark = texts.sparkSession
    split = [n.split() for n in norms]
    many = [i for i, words in enumerate(split) if len(words) > 1]
    vocabulary = sorted({w for i in many for w in split[i]})
    number = {w: k for k, w in enumerate(vocabulary)}
    related = [(len(norms) + number[w], i, number[w]) for i in many for w in set(split[i])]
    says = spark.createDataFrame([(i, i, None) for i in range(len(norms))] + related, "term int, kw int, word_no int")
    small = F.broadcast if len(norms) <= BROADCAST_KEYWORDS else lambda df: df
    rows = held_rows(texts, keep, text, norms + vocabulary).join(small(says), "term").select(*keep, "kw", "word_no")
    if many:
        inside = containing_terms(spark, vocabulary).withColumn("term", F.col("term") + len(norms)).join(small(says), "term")
        words = compute_all(texts.select(*keep, F.col(text).alias("_n")), {"_words": F.array_distinct(F.split("_n", " "))})
        each = explode_rows(words, keep, F.col("_words"), "word").filter("word <> ''")
        rows = rows.unionByName(each.join(small(inside), "word").select(*keep, "kw", "word_no"))
    return rows


def scattered_rows(texts: DataFrame, keep: list[str], text: str, norms: list[str]) -> DataFrame:
    """``keep``, kw: the keywords of several words each of which is related to a word of the normalised text.

    ``keep`` must tell the texts apart.
    """
    sizes = [(i, len(set(n.split()))) for i, n in enumerate(norms)]
    rows = keyword_evidence(texts, keep, text, norms).filter(F.col("word_no").isNotNull())
    met = rows.groupBy(*keep, "kw").agg(F.size(F.collect_set("word_no")).alias("met"))
    wanted = texts.sparkSession.createDataFrame(sizes, "kw int, met int")
    wanted = F.broadcast(wanted) if len(norms) <= BROADCAST_KEYWORDS else wanted
    return met.join(wanted, ["kw", "met"]).select(*keep, "kw")


def fuzzy_table(texts: DataFrame, slots: list[FuzzySlot], threshold: float, text: str = "text") -> DataFrame:
    """(t1, t2, found): the best fuzzy match of every slot for each distinct text that has one."""
    spark = texts.sparkSession
    ship_package(spark)
    raws = sorted({k for s in slots for k in s.keywords})
    number = {k: i for i, k in enumerate(raws)}
    # A keyword that a list repeats counts at its first place.
    places = [(s.slot, place, number[k]) for s in slots for k, place in {k: i for i, k in reversed(list(enumerate(s.keywords)))}.items()]
    listed = spark.createDataFrame(places, "slot int, place int, kw int")
    norms = [normalise_for_match(k) for k in raws]
    split = [n.split() for n in norms]
    many = [i for i, words in enumerate(split) if len(words) > 1]
    floor = threshold - SLACK

    base = texts.select(*[c.alias(i) for i, c in zip(ID, text_id(F.col(text)), strict=True)], F.col(text).alias("text"))
    base = base.filter("t1 IS NOT NULL").groupBy(*ID).agg(F.first("text").alias("text"))
    base = compute_all(base, {"n": match_normalise(F.col("text"))}).filter("n <> ''").select(*ID, "n")
    # Three passes read the texts; without the cut each would run the plan that makes them.
    ensure_checkpoint_dir(spark)
    base = compute_all(base.checkpoint(), {"w": F.split("n", " ")})

    rows = keyword_evidence(base, ID, "n", norms)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("win", "string"), ("ratio", "double"))]
    rows = rows.select("*", *nothing)
    if many:
        close = close_windows(base, ID, "w", [(i, norms[i]) for i in many], floor)
        rows = rows.unionByName(close.select(*ID, "kw", F.lit(-1).alias("word_no"), "pos", "win", "ratio"))

    ratio = F.col("ratio")
    per_keyword = rows.groupBy(*ID, "kw").agg(
        F.max(F.col("word_no").isNull()).alias("contained"),
        F.size(F.collect_set(F.when(F.col("word_no") >= 0, F.col("word_no")))).alias("words_met"),
        F.min(F.when(ratio >= threshold, F.struct("pos", "ratio", "win"))).alias("first"),
        F.min(F.when(ratio.isNotNull(), F.struct((-ratio).alias("neg"), "pos", "win"))).alias("best"),
    )
    names = [(i, raw, " ".join(words), len(set(words)) if len(words) > 1 else None) for i, (raw, words) in enumerate(zip(raws, split, strict=True))]
    names = F.broadcast(spark.createDataFrame(names, "kw int, raw string, words string, n_words int"))
    per_keyword = per_keyword.join(names, "kw")
    scattered = F.col("words_met") == F.col("n_words")
    known = F.col("contained") | F.col("first").isNotNull() | scattered | F.col("best").isNotNull()
    score = F.when(F.col("contained"), 1.0).when(F.col("first").isNotNull(), F.col("first.ratio"))
    score = score.when(scattered, SCATTERED_SCORE).otherwise(-F.col("best.neg"))
    evidence = F.when(F.col("contained"), F.col("raw")).when(F.col("first").isNotNull(), F.col("first.win"))
    evidence = evidence.when(scattered, F.concat(F.lit("scattered:"), "words")).otherwise(F.col("best.win"))
    per_keyword = per_keyword.filter(known)
    scored = per_keyword.select(*ID, "kw", score.alias("score"), evidence.alias("evidence")).join(F.broadcast(listed), "kw")
    best = scored.groupBy(*ID, "slot").agg(F.min(F.struct((-F.col("score")).alias("neg"), "place", "evidence")).alias("m"))
    match = F.struct("slot", (-F.col("m.neg")).alias("score"), F.col("m.evidence").alias("evidence"))
    return best.groupBy(*ID).agg(F.sort_array(F.collect_list(match)).cast(FUZZY_SCHEMA).alias("found"))


def normalise_for_match(text: str) -> str:
    return " ".join(text.lower().split())


def add_fuzzy_matches(df: DataFrame, text: str, slots: list[FuzzySlot], threshold: float, name: str = "_fuzzy") -> DataFrame:
    """``df`` with the best fuzzy match of every slot, an array; null where the text is null or has no match."""
    if df.isStreaming:
        raise ValueError("fuzzy matching collapses equal texts: match a stream batch by batch (streaming.run.append_batches)")
    table = fuzzy_table(df.select(text), slots, threshold, text)
    table = table.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("found").alias(name))
    t1, t2 = text_id(F.col(text))
    # Rows without a text meet nothing; the hash of their other columns deals them to all tasks instead of one.
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    keyed = df.withColumns({"_t1": F.coalesce(t1, dealt), "_t2": t2})
    return keyed.join(table, ["_t1", "_t2"], "left").select(*df.columns, name)
