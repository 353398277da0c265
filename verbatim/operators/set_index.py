"""Similarity lookup of word sets in a bounded table of sets that every task holds.

The words of the held sets are ordered from rare to frequent among these sets; words that none of them has come before all
others. In any such order two sets can only be similar enough if the rare ends of both share a word, so a set is looked up by
the words of its own end in the ends of the held ones, and confirmed on the whole sets. No set leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that the expansion of places or of words holds at once, unless a single one has more.
EXPANDED = 1_000_000


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    # Rounding guards against 0.65 * 20 coming out a hair above 13.
    return size - np.ceil(np.round(size * threshold, 6)).astype(np.int64) + 1


def _runs(lengths: np.ndarray, most: int = EXPANDED) -> Iterator[slice]:
    """Slices whose lengths sum to about ``most``."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the number of the range and the place, one row per place."""
    number = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return number, starts[number] + within


@dataclass
class SetIndex:
    """Held sets: words as ranks in one order, and where each rank lies in the rare ends."""

    threshold: float
    names: pa.Array
    groups: np.ndarray
    vocabulary: pa.Array
    codes: np.ndarray
    ranks: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    members: np.ndarray
    post_starts: np.ndarray
    post_set: np.ndarray
    post_place: np.ndarray

    @classmethod
    def build(cls, table: pa.Table, threshold: float) -> SetIndex:
        """``table`` has (name, grp, words): distinct words of one set of a numbered group."""
        table = table.combine_chunks()
        words = pa.concat_arrays(table.column("words").chunks) if table.num_rows else pa.array([], table.schema.field("words").type)
        number = pc.list_parent_indices(words).to_numpy()
        sizes = np.bincount(number, minlength=len(words))
        encoded = words.flatten().dictionary_encode()
        groups, group = np.unique(table.column("grp").to_numpy(), return_inverse=True)
        code = group[number] * len(encoded.dictionary) + encoded.indices.to_numpy()
        codes, back, count = np.unique(code, return_inverse=True, return_counts=True)
        ranks = np.empty(len(codes), np.int64)
        ranks[np.argsort(count, kind="stable")] = np.arange(len(codes))
        members = ranks[back]
        members = members[np.lexsort((members, number))]
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(members)) - starts[number]
        end = np.flatnonzero(place < prefix_size(sizes, threshold)[number])
        end = end[np.argsort(members[end], kind="stable")]
        post_starts = np.searchsorted(members[end], np.arange(len(codes) + 1))
        names = table.column("name").combine_chunks()
        return cls(threshold, names, groups, encoded.dictionary, codes, ranks, sizes, starts, members, post_starts, number[end], place[end])

    def mark(self, group: np.ndarray, words: pa.Array, near: np.ndarray) -> None:
        """Set ``near`` of the held sets that are similar to one of these sets of distinct words."""
        t = self.threshold
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(words).to_numpy()
        word = pc.fill_null(pc.index_in(words.flatten(), value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        code = np.searchsorted(self.groups, group)[row] * len(self.vocabulary) + word
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        held = (word >= 0) & (self.codes[at] == code)
        row, rank = row[held], self.ranks[at[held]]
        order = np.lexsort((rank, row))
        row, rank = row[order], rank[order]
        count = np.bincount(row, minlength=len(size))
        place = np.arange(len(row)) - (np.cumsum(count) - size)[row]  # words that no held set has come first
        own = row * len(self.codes) + rank
        probe = np.flatnonzero(place < prefix_size(size, t)[row])
        first, found = self.post_starts[rank[probe]], self.post_starts[rank[probe] + 1] - self.post_starts[rank[probe]]
        for part in _runs(found):
            source, post = _expanded(first[part], found[part])
            source, held = probe[part][source], self.post_set[post]
            a, b = self.sizes[held], size[row[source]]
            reach = np.minimum(a - self.post_place[post], b - place[source])
            possible = (a >= b * t - 1e-9) & (b >= a * t - 1e-9) & (reach >= (a + b) * (t / (1 + t)) - 1e-6) & ~near[held]
            pairs = np.unique(row[source[possible]] * len(self.sizes) + held[possible])
            rows, held = np.divmod(pairs, len(self.sizes))
            for some in _runs(self.sizes[held]):
                r, h = rows[some], held[some]
                pair, member = _expanded(self.starts[h], self.sizes[h])
                wanted = r[pair] * len(self.codes) + self.members[member]
                hit = own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
                common = np.bincount(pair[hit], minlength=len(h))
                near[h[common / (size[r] + self.sizes[h] - common) >= t]] = True


def near_names(shared) -> Callable:
    """(grp, words) to the names of the held sets that a task has found similar ones for, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        near = np.zeros(len(index.names), bool)
        for batch in batches:
            if batch.num_rows and len(near):
                index.mark(batch.column(0).to_numpy(), batch.column(1), near)
        yield pa.RecordBatch.from_arrays([index.names.filter(pa.array(near))], ["set_id"])

    return run


def rare_ends(shared, threshold: float) -> Callable:
    """(number, codes) of sets to (code, number, size, place, bits), one row per word of the rare end.

    Codes in the shared array come last, as there; all others come first, by their value. ``bits`` has a bit per word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        by_code = np.argsort(common)
        known = common[by_code]
        for batch in batches:
            number, codes = batch.column(0).to_numpy(), batch.column(1)
            size = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
            code = codes.flatten().to_numpy()
            if not len(code):
                continue
            row = np.repeat(np.arange(len(size)), size)
            rank = np.full(len(code), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                rank = np.where(known[at] == code, by_code[at], -1)
            filled = np.flatnonzero(size)
            starts = np.cumsum(size) - size
            bits = np.zeros(len(size), np.uint64)
            bits[filled] = np.bitwise_or.reduceat(np.uint64(1) << (code.view(np.uint64) & np.uint64(63)), starts[filled])
            order = np.lexsort((code, rank, row))
            place = np.arange(len(code)) - starts[row]
            end = np.flatnonzero(place < prefix_size(size, threshold)[row])
            own = row[end]
            columns = [code[order[end]], number[own], size[own].astype(np.int32), place[end].astype(np.int32), bits[own].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "number", "size", "place", "bits"])

    return run


def _whole_codes(batches: Iterator[pa.RecordBatch], rows: int = EXPANDED) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, in pieces of ``rows`` and more that end where it changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) >= rows:
            piece = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(piece[0], piece[0][-1]))
            held = [[c[cut:] for c in piece]]
            if cut:
                yield [c[:cut] for c in piece]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def meeting(threshold: float) -> Callable:
    """Rows of ``rare_ends`` sorted by code and size to the pairs (x, y) of numbers that could be similar, x the smaller set.

    The smaller set needs to show fewer words, as the larger one has as many. A shared word counts if the words behind it, in
    both sets, could still make up the overlap, and if no more bits differ than words may.
    """
    t, share = threshold, threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, number, size, place, bits in _whole_codes(batches):
            size = size.astype(np.int64)
            step = np.int64(size.max() + 1)
            key = np.cumsum(np.append(0, code[1:] != code[:-1])) * step
            shown = np.flatnonzero(place < size - np.ceil(np.round(2 * share * size, 6)) + 1)
            at = (key + size)[shown]
            first = np.searchsorted(at, key + np.ceil(size * t - 1e-9).astype(np.int64))
            found = np.searchsorted(at, key + size, side="right") - first
            for part in _runs(found):
                y, post = _expanded(first[part], found[part])
                y, x = y + part.start, shown[post]
                total = size[x] + size[y]
                needed = total * share - 1e-6
                possible = (size[x] < size[y]) | (number[x] < number[y])
                possible &= np.minimum(size[x] - place[x], size[y] - place[y]) >= needed
                possible &= np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) <= total - 2 * needed  # of signed numbers it counts the magnitude
                pairs = np.unique(np.stack([number[x[possible]], number[y[possible]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

    return run
