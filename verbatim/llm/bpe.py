"""Byte-pair encoding and decoding with a given vocabulary file.

A text is cut at added tokens, then into pre-tokens; each pre-token starts as a doubly linked list of byte symbols. A
priority queue holds the possible merges by (rank, position); a popped entry whose symbols have since merged is
stale and skipped. The work is n log n in the length of a pre-token, however long it is. Decoding concatenates the vocabulary
strings of the ids and reads the bytes as UTF-8.

The vocabulary is a file that every executor has; its path is a parameter. Encoded pre-tokens are remembered in a bounded
table per Python worker.

Defined results: null encodes as the empty list and decodes as the empty text; ids outside the vocabulary decode to nothing;
bytes that are no UTF-8 decode to U+FFFD. Only the given column is read; rows are independent, so repeated rows and an
empty table need no care.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level vocabularies (fixed value); white space is the Unicode property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens, and pieces of text, that a worker remembers (twice as many for a short while).
REMEMBERED, REMEMBERED_PIECES = 200_000, 100_000
LONGEST_REMEMBERED = 64
PLACE = (1 << 40) - 1
#: Marks that make one pre-token together (no apostrophe, letter, digit or space).
MARKS = ".,;:!?#*$%&|<>()"
#: A space after white space, a leading space, or a character that only Python takes for white space.
ODD_SPACE = re.compile(r"\s |\A |[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next unused one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """Text to ids, filled on demand by ``work``. When full, the entries become the older half, which is dropped next time."""

    def __init__(self, work, room: int):
        super().__init__()
        self.work, self.room, self.older = work, room, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = self.work(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Vocabulary:
    """A vocabulary file, ready to encode and decode."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        added = {}
        for token in file.get("added_tokens") or []:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"added tokens that take in their surroundings are not supported: {token['content']}")
            added[token["content"]] = token["id"]
        self.added = added
        self.byte_ids = [ids[c] for c in letters]
        # Ranks by left symbol, then right; what the pair of a rank becomes.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.becomes: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[ids[left]][ids[right]] = rank
            self.becomes.append(ids[left + right])
        self.strings = [b""] * (max(*ids.values(), *added.values(), 0) + 1)
        for s, i in ids.items():
            self.strings[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.merged = Remembered(lambda t: self.merge(t.encode()), remembered)
        self.spaced = Remembered(self.after_space, REMEMBERED_PIECES)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The merges of one pre-token. A queue entry is rank and place in one number."""
        symbols = [self.byte_ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        ranks, becomes = self.ranks, self.becomes
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [
            rank << 40 | i
            for i, (a, b) in enumerate(pairwise(symbols))
            if (rank := ranks[a].get(b)) is not None
        ]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 40, entry & PLACE
            left = symbols[i]
            if left < 0 or (j := after[i]) == n or ranks[left].get(symbols[j]) != rank:
                continue  # stale: a symbol of the pair is gone, or the pair here is another by now
            symbols[i] = new = becomes[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks[new].get(symbols[k])) is not None:
                    heappush(queue, rank << 40 | i)
            h = before[i]
            if h >= 0 and (rank := ranks[symbols[h]].get(new)) is not None:
                heappush(queue, rank << 40 | h)
        return tuple([s for s in symbols if s >= 0])

    def pre_tokenized(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.merged.__getitem__, self.pre_tokens(text))))

    def after_space(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece with the space before it; letters with marks behind them need no pattern."""
        if piece.isalpha():
            return self.merged[f" {piece}"]
        core = piece.rstrip(MARKS)
        if core.isalpha():
            return self.merged[f" {core}"] + self.merged[piece[len(core) :]]
        return self.pre_tokenized(f" {piece}")

    def plain(self, text: str) -> Iterator[int]:
        """Ids of a text without added tokens.

        A pre-token never runs from a non-space into a space, so a text can be cut before every space that follows a
        non-space, and the pieces be looked up whole. Texts where that is not so for every space go the long way.
        """
        if not text or ODD_SPACE(text):
            return iter(self.pre_tokenized(text))
        pieces = text.split(" ")
        first = self.pre_tokenized(pieces[0]) if pieces[0] else ()
        return chain(first, chain.from_iterable(map(self.spaced.__getitem__, islice(pieces, 1, None))))

    def ids_of(self, text: str) -> Iterator[int]:
        if self.cut is None or not (hits := list(self.cut.finditer(text))):
            return self.plain(text)
        parts, at = [], 0
        for hit in hits:
            parts += [self.plain(text[at : hit.start()]), (self.added[hit.group()],)]
            at = hit.end()
        return chain.from_iterable([*parts, self.plain(text[at:])])

    def text_of(self, ids: list[int]) -> str:
        try:
            if ids and min(ids) < 0:
                raise IndexError
            data = b"".join(map(self.strings.__getitem__, ids))
        except IndexError:
            data = b"".join([self.strings[i] for i in ids if 0 <= i < len(self.strings)])
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """The ids of each text, array<int>."""
    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        vocab = vocabulary(path)
        for batch in texts:
            flat, ends = array("i"), [0]
            for text in batch:
                flat.extend(vocab.ids_of(text.as_py() or ""))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.frombuffer(flat, "int32")))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each list of ids."""
    @F.arrow_udf("string")
    def texts(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in lists:
            yield pa.array([vocab.text_of(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch], pa.string())

    return texts(ids)
