"""Keyword and fuzzy theme assignment.

The taxonomy is a driver-side object. Exact matching is a hashed lookup of word n-grams inside the row: no join, no
shuffle, no row key, usable on a stream. Up to ``MAX_LITERAL_KEYWORDS`` keywords the table rides in the plan; a larger one is
broadcast in parts of a bounded size and looked up a batch at a time. Both give the same hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from verbatim.functions import literals
from verbatim.functions.expr import bind, compute_once, round_binary
from verbatim.functions.ngrams import is_plain_keyword, keyword_hits, match_line, match_words, pattern_hits
from verbatim.functions.patterns import word_bounded
from verbatim.functions.quality import is_dismissive_short
from verbatim.functions.text import strip
from verbatim.operators import assignments as out
from verbatim.operators.fuzzy import FuzzySlot, add_fuzzy_matches
from verbatim.session import ship_package
from verbatim.settings import KeywordSettings

MAX_LITERAL_KEYWORDS = 5_000
#: Up to so many plain keywords are looked for one by one, which needs no word n-grams.
MAX_SCANNED_KEYWORDS = 64
#: Keyword text in one broadcast part of a large library.
SHARD_BYTES = 32 << 20

TOKEN, PHRASE = 0, 1

INDEX_SCHEMA = (
    "subtheme_pos int, theme string, parent_theme string, subtheme string, phrase_terms array<string>, "
    "token_terms array<string>, cols array<string>, polarity string"
)
_HIT_SCHEMA = "array<struct<pos: int, kind: int, kw: int, evidence: string>>"
_META_SCHEMA = (
    "struct<theme: string, subtheme: string, parent_theme: string, polarity: string, cols: array<string>>"
)
_FUZZY_TO_CANDIDATE = "array<struct<pos: int, rank: int, kw: int, base: double, method: string, evidence: string>>"


@dataclass(frozen=True)
class Subtheme:
    theme: str
    parent_theme: str
    subtheme: str
    phrase_terms: tuple[str, ...]
    token_terms: tuple[str, ...]
    cols: tuple[str, ...]
    polarity: str


@dataclass(frozen=True)
class KeywordIndex:
    """The keyword taxonomy in file order; positions break ties."""

    subthemes: tuple[Subtheme, ...]

    @classmethod
    def from_themes(cls, config: Mapping[str, Any]) -> KeywordIndex:
        """Build from a parsed themes file."""
        entries = []
        for theme, block in (config.get("themes") or {}).items():
            for st in block.get("subthemes") or []:
                terms = [str(k).strip() for k in st.get("keywords_phrases") or [] if str(k).strip()]
                phrases = tuple(t for t in terms if re.search("[ _-]", t))
                cols = st.get("allowed_columns") or st.get("likely_columns") or []
                entries.append(
                    Subtheme(
                        theme, block.get("parent_theme", theme), st.get("name", ""), phrases,
                        tuple(t for t in terms if t not in phrases), tuple(sorted(set(cols))),
                        st.get("default_polarity", "Either"),
                    )
                )
        return cls(tuple(entries))

    @classmethod
    def from_df(cls, df: DataFrame) -> KeywordIndex:
        """Read an index table (``INDEX_SCHEMA``) back. An index is a driver-side object, one entry per subtheme."""
        rows = df.orderBy("subtheme_pos").collect()
        return cls(
            tuple(
                Subtheme(r["theme"], r["parent_theme"], r["subtheme"], tuple(r["phrase_terms"]),
                         tuple(r["token_terms"]), tuple(r["cols"]), r["polarity"])
                for r in rows
            )
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            Row(subtheme_pos=i, theme=s.theme, parent_theme=s.parent_theme, subtheme=s.subtheme,
                phrase_terms=list(s.phrase_terms), token_terms=list(s.token_terms), cols=list(s.cols),
                polarity=s.polarity)
            for i, s in enumerate(self.subthemes)
        ]
        return spark.createDataFrame(rows, INDEX_SCHEMA)

    def entries(self) -> Iterable[tuple[str, dict[str, Any]]]:
        """(lower-cased keyword, hit) in list order."""
        for pos, s in enumerate(self.subthemes):
            for kind, terms in ((TOKEN, s.token_terms), (PHRASE, s.phrase_terms)):
                for kw, term in enumerate(terms):
                    yield term.lower(), {"pos": pos, "kind": kind, "kw": kw, "evidence": term}

    def n_keywords(self) -> int:
        return sum(len(s.phrase_terms) + len(s.token_terms) for s in self.subthemes)

    def meta(self) -> list[dict[str, Any]]:
        return [
            {"theme": s.theme, "subtheme": s.subtheme, "parent_theme": s.parent_theme, "polarity": s.polarity,
             "cols": list(s.cols)}
            for s in self.subthemes
        ]


# --------------------------------------------------------------------------------------------------------------
# Exact hits
# --------------------------------------------------------------------------------------------------------------


def _hit_table(index: KeywordIndex) -> dict[str, list[dict[str, Any]]]:
    table: dict[str, list[dict[str, Any]]] = {}
    for key, hit in index.entries():
        table.setdefault(key, []).append(hit)
    return table


def add_exact_hits(df: DataFrame, text: Column, index: KeywordIndex, name: str = "_hits") -> DataFrame:
    """Add every keyword hit of a row as an array, by lookup inside the row."""
    table = _hit_table(index)
    plain = [k for k in table if is_plain_keyword(k)]
    odd = [k for k in table if not is_plain_keyword(k)]
    if len(plain) <= MAX_SCANNED_KEYWORDS:
        return df.withColumn(name, _scanned_hits(text, {k: table[k] for k in plain}, {k: table[k] for k in odd}))
    # Each step is its own projection: the optimizer keeps shared intermediate arrays instead of recomputing them.
    staged = df.withColumn("_words", match_words(text))
    keys = keyword_hits(F.col("_words"), plain)
    keys = F.concat(keys, pattern_hits(text, odd)) if odd else keys
    staged = staged.withColumn("_keys", keys)
    hits = F.flatten(F.transform(F.col("_keys"), lambda k: literals.lookup(k, table, _HIT_SCHEMA)))
    return staged.withColumn(name, hits).drop("_words", "_keys")


def _scanned_hits(text: Column, plain: dict, odd: dict) -> Column:
    """The hits of a small table: its keywords are looked for one by one in the line of words."""
    entries = [{"marked": f" {k} ", "hits": hits} for k, hits in plain.items()]
    table = literals.literal(entries, f"array<struct<marked: string, hits: {_HIT_SCHEMA}>>")
    held = bind(match_line(text), lambda line: F.filter(table, lambda e: F.contains(line, e["marked"])))
    hits = F.when(text.isNotNull(), F.flatten(F.transform(held, lambda e: e["hits"])))
    if not odd:
        return hits
    return F.concat(hits, F.flatten(F.transform(pattern_hits(text, odd), lambda k: literals.lookup(k, odd, _HIT_SCHEMA))))


@dataclass(frozen=True)
class KeywordShard:
    """A part of the plain keywords: by number of words, the keywords and the numbers of their hits in ``hits``."""

    keywords: dict[int, pa.Array]
    first: dict[int, np.ndarray]
    count: dict[int, np.ndarray]
    hits: pa.StructArray


def keyword_shards(index: KeywordIndex, shard_bytes: int = SHARD_BYTES) -> list[KeywordShard]:
    """The plain keywords in parts of at most ``shard_bytes`` of text, each small enough to broadcast."""
    shards, keys, size = [], [], 0
    table = {k: v for k, v in _hit_table(index).items() if is_plain_keyword(k)}
    fields = [("pos", pa.int32()), ("kind", pa.int32()), ("kw", pa.int32()), ("evidence", pa.string())]

    def close() -> None:
        by_length: dict[int, list[str]] = {}
        for k in keys:
            by_length.setdefault(len(k.split(" ")), []).append(k)
        ordered = [k for terms in by_length.values() for k in terms]
        counts = np.array([len(table[k]) for k in ordered], np.int64)
        starts = np.cumsum(counts) - counts
        hits = pa.array([h for k in ordered for h in table[k]], pa.struct(fields))
        words, first, count, at = {}, {}, {}, 0
        for n, terms in by_length.items():
            words[n], first[n], count[n] = pa.array(terms), starts[at : at + len(terms)], counts[at : at + len(terms)]
            at += len(terms)
        shards.append(KeywordShard(words, first, count, hits))

    for key, entries in table.items():
        keys.append(key)
        size += len(key.encode()) + sum(len(h["evidence"].encode()) + 40 for h in entries)
        if size > shard_bytes:
            close()
            keys, size = [], 0
    if keys:
        close()
    return shards


def _shard_hits(words: pa.Array, shard: KeywordShard) -> pa.Array:
    """The hits of one batch of word arrays, null where the words are null; all rows are looked up together."""
    sizes = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = words.flatten()
    row = np.repeat(np.arange(len(words)), sizes)
    rows, starts, counts = [], [], []
    grams = flat
    for n in range(1, max(shard.keywords) + 1):
        if n > 1:
            if len(flat) < n:
                break
            grams = pc.binary_join_element_wise(grams.slice(0, len(flat) - n + 1), flat.slice(n - 1), " ")
        if n not in shard.keywords:
            continue
        at = pc.index_in(grams, value_set=shard.keywords[n])
        found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        found = found[row[found] == row[found + n - 1]]
        keyword = at.take(pa.array(found)).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(np.stack([row[found], keyword]), axis=1) if len(found) else np.empty((2, 0), np.int64)
        rows.append(pairs[0])
        starts.append(shard.first[n][pairs[1]])
        counts.append(shard.count[n][pairs[1]])
    hit_row, start, count = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, starts, counts))
    order = np.argsort(hit_row, kind="stable")
    hit_row, start, count = hit_row[order], start[order], count[order]
    places = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    ends = np.concatenate([[0], np.cumsum(np.bincount(hit_row, count, len(words)).astype(np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), shard.hits.take(pa.array(places)), mask=words.is_null())


def add_exact_hits_by_table(
    df: DataFrame, text: Column, index: KeywordIndex, name: str = "_hits", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The same array for libraries too large for the plan: broadcast in parts of a bounded size, looked up in the row.

    No row is joined or regrouped, so rows need no key, and the operator runs on a stream. Batches are looked up whole.
    """
    ship_package(df.sparkSession)
    odd = [k for k in _hit_table(index) if not is_plain_keyword(k)]
    staged = df.withColumn("_words", match_words(text))
    found = []
    for shard in keyword_shards(index, shard_bytes):
        shared = df.sparkSession.sparkContext.broadcast(shard)
        found.append(_lookup(shared)(F.col("_words")))
    if odd:
        table = {k: v for k, v in _hit_table(index).items() if k in set(odd)}
        hits = F.transform(pattern_hits(text, odd), lambda k: literals.lookup(k, table, _HIT_SCHEMA))
        found.append(F.flatten(hits))
    none = F.when(text.isNotNull(), F.array().cast(_HIT_SCHEMA))
    hits = F.concat(*found) if len(found) > 1 else found[0] if found else none
    return staged.withColumn(name, hits.cast(_HIT_SCHEMA)).drop("_words")


def _lookup(shared: Any) -> Any:
    @F.arrow_udf(_HIT_SCHEMA)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield _shard_hits(words, shared.value)

    return hits


def add_exact_hits_by_pattern(df: DataFrame, text: Column, index: KeywordIndex, name: str = "_hits") -> DataFrame:
    """The same hits with one pattern per keyword: the readable twin the tests compare against."""
    structs = []
    for key, hit in index.entries():
        value = F.struct(
            F.lit(hit["pos"]).alias("pos"), F.lit(hit["kind"]).alias("kind"), F.lit(hit["kw"]).alias("kw"),
            F.lit(hit["evidence"]).alias("evidence"),
        )
        structs.append(F.when(text.rlike(f"(?iu){word_bounded(key)}"), value))
    return df.withColumn(name, F.array_compact(F.array(*structs)))


# --------------------------------------------------------------------------------------------------------------
# Candidates and scores
# --------------------------------------------------------------------------------------------------------------


def _exact_candidates(hits: Column, short: Column, cfg: KeywordSettings) -> Column:
    """Hits as ranked candidates: the lowest rank of a subtheme is the one that counts."""

    def candidate(h: Column, rank: int, kw: Column, base: float, method: str) -> Column:
        return F.struct(
            h["pos"].alias("pos"), F.lit(rank).alias("rank"), kw.alias("kw"), F.lit(base).alias("base"),
            F.lit(method).alias("method"), h["evidence"].alias("evidence"),
        )

    tokens = F.when(short, F.filter(hits, lambda h: h["kind"] == TOKEN)).otherwise(F.filter(hits, lambda h: F.lit(False)))
    if cfg.phrase_first:
        short_tokens = F.transform(tokens, lambda h: candidate(h, 0, h["kw"], 0.95, "token_short_text"))
        phrases = F.filter(hits, lambda h: h["kind"] == PHRASE)
        return F.concat(short_tokens, F.transform(phrases, lambda h: candidate(h, 2, h["kw"], 1.0, "exact")))
    # Phrases come before tokens in the combined list.
    order = lambda h: h["kw"] + F.when(h["kind"] == TOKEN, F.lit(1 << 30)).otherwise(0)
    combined = F.transform(hits, lambda h: candidate(h, 0, order(h), 1.0, "exact"))
    return F.concat(combined, F.transform(tokens, lambda h: candidate(h, 2, h["kw"], 0.95, "token_short_text")))


def _fuzzy_slots(index: KeywordIndex, cfg: KeywordSettings) -> list[FuzzySlot]:
    slots = []
    for pos, s in enumerate(index.subthemes):
        if cfg.allow_token_fallback and s.token_terms:
            slots.append(FuzzySlot(pos * 2 + TOKEN, s.token_terms))
        terms = s.phrase_terms if cfg.phrase_first else s.phrase_terms + s.token_terms
        if terms:
            slots.append(FuzzySlot(pos * 2 + PHRASE, terms))
    return slots


def _skip_slots(hits: Column, short: Column, cfg: KeywordSettings) -> Column:
    """Slots an exact hit has settled: fuzzy matching may not, or need not, look at them."""
    phrase_slot = F.transform(hits, lambda h: h["pos"] * 2 + PHRASE)
    if cfg.phrase_first:
        settled = F.filter(hits, lambda h: (h["kind"] == PHRASE) | short)
        phrase_slot = F.transform(settled, lambda h: h["pos"] * 2 + PHRASE)
    token_hits = F.filter(hits, lambda h: h["kind"] == TOKEN)
    token_slot = F.when(short, F.transform(token_hits, lambda h: h["pos"] * 2 + TOKEN)).otherwise(F.array(F.lit(-1)))
    return F.array_sort(F.array_distinct(F.concat(phrase_slot, token_slot)))


def _settled(slot: Column, skip: Column) -> Column:
    """-1 among the skipped slots stands for all token lists, which have even numbers."""
    return F.array_contains(skip, slot) | (F.array_contains(skip, F.lit(-1)) & (slot % 2 == TOKEN))


def _fuzzy_candidates(found: Column, cfg: KeywordSettings) -> Column:
    token_rank, phrase_rank = (1, 3) if cfg.phrase_first else (3, 1)

    def candidate(m: Column) -> Column:
        is_token = m["slot"] % 2 == TOKEN
        return F.struct(
            F.floor(m["slot"] / 2).cast("int").alias("pos"),
            F.when(is_token, token_rank).otherwise(phrase_rank).alias("rank"),
            F.lit(0).alias("kw"),
            m["score"].alias("base"),
            F.when(is_token, "fuzzy_token").otherwise("fuzzy").alias("method"),
            m["evidence"].alias("evidence"),
        )

    return F.coalesce(F.transform(found, candidate), F.array().cast(_FUZZY_TO_CANDIDATE))


def _first_per_subtheme(ranked: Column) -> Column:
    return F.filter(
        ranked, lambda c, i: F.when(i == 0, True).otherwise(c["pos"] != F.get(ranked, i - 1)["pos"])
    )


def _scored(candidates: Column, text_column: Column, index: KeywordIndex, cfg: KeywordSettings) -> Column:
    """Accepted candidates in rank order, cut to the best ``top_k``."""

    def score(c: Column) -> Column:
        meta = literals.element(index.meta(), c["pos"], _META_SCHEMA)
        listed, member = F.size(meta["cols"]) > 0, F.array_contains(meta["cols"], text_column)
        bonus = F.when(listed & member, cfg.column_bonus).otherwise(0.0)
        mismatch = 999.0 if cfg.strict_columns else cfg.column_penalty
        penalty = F.when(listed & ~member, mismatch).otherwise(0.0)
        bump = F.when((c["method"] == "exact") & F.lit(cfg.prefer_exact), 0.02).otherwise(0.0)
        total = c["base"] + bonus - penalty + bump
        return F.struct(
            (-total).alias("neg_score"), c["pos"].alias("pos"), meta["theme"].alias("theme"),
            meta["subtheme"].alias("subtheme"), meta["parent_theme"].alias("parent_theme"), total.alias("score"),
            c["method"].alias("method"), c["evidence"].alias("evidence"), meta["polarity"].alias("polarity"),
            F.struct(
                round_binary(c["base"], 3).alias("base_score"), round_binary(bonus, 3).alias("column_bonus"),
                round_binary(penalty, 3).alias("column_penalty"), bump.alias("exact_preference_bump"),
            ).alias("components"),
        )

    accepted = F.filter(F.transform(candidates, score), lambda m: m["score"] >= cfg.min_accept_score)
    return F.slice(F.array_sort(accepted), 1, cfg.top_k)


def add_matches(
    df: DataFrame,
    index: KeywordIndex,
    settings: KeywordSettings = KeywordSettings(),
    active: Column | None = None,
    exact: str = "auto",
) -> DataFrame:
    """Add ``matches``: the best ``top_k`` themes of each (``TextColumn``, ``text``) row, best first.

    Rows where ``active`` is false are not matched. ``exact`` picks the lookup: ``row`` (in the plan), ``table`` (broadcast),
    ``pattern``, or ``auto`` by library size; all give the same matches.
    """
    before = list(df.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    on = F.lit(True) if active is None else active
    staged = df.withColumn("_text", F.when(on, text))
    if exact == "auto":
        exact = "row" if index.n_keywords() <= MAX_LITERAL_KEYWORDS else "table"
    if exact == "table":
        staged = add_exact_hits_by_table(staged, F.col("_text"), index)
    elif exact == "pattern":
        staged = add_exact_hits_by_pattern(staged, F.col("_text"), index)
    else:
        staged = add_exact_hits(staged, F.col("_text"), index)

    hits = F.col("_hits")
    short = F.lit(settings.allow_token_fallback) & (F.length(strip(F.col("_text"))) <= settings.max_token_match_length)
    staged = staged.withColumn("_short", F.coalesce(short, F.lit(False)))
    candidates = _exact_candidates(hits, F.col("_short"), settings)
    if settings.use_fuzzy:
        staged = staged.withColumn("_skip", _skip_slots(hits, F.col("_short"), settings))
        staged = add_fuzzy_matches(staged, "_text", _fuzzy_slots(index, settings), settings.fuzzy_threshold)
        open_slots = F.filter("_fuzzy", lambda m: ~_settled(m["slot"], F.col("_skip")))
        candidates = F.concat(candidates, _fuzzy_candidates(open_slots, settings))
    first_per_subtheme = bind(F.array_sort(candidates), _first_per_subtheme)
    staged = compute_once(staged, "matches", _scored(first_per_subtheme, F.col("TextColumn"), index, settings))
    return staged.select(*before, "matches")


def add_best_match(df: DataFrame, index: KeywordIndex, settings: KeywordSettings = KeywordSettings(), **kw) -> DataFrame:
    """Add ``match``: the single best theme, or null."""
    return add_matches(df, index, settings, **kw).withColumn("match", F.get("matches", F.lit(0))).drop("matches")


def collapse_matches(matches: Column, settings: KeywordSettings) -> dict[str, Column]:
    """Matched labels joined in rank order; blank evidence and polarity are left out."""
    kept = matches if settings.multi_label else F.slice(matches, 1, 1)
    d = settings.delimiter
    return {
        "theme": out.join_field(kept, "theme", d),
        "subtheme": out.join_field(kept, "subtheme", d),
        "parent_theme": out.join_field(kept, "parent_theme", d),
        "rule_score": out.mean_field(kept, "score"),
        "expected_polarity": out.join_field(kept, "polarity", d, skip_blank=True),
        "match_method": out.join_field(kept, "method", d),
        "evidence": out.join_field(kept, "evidence", d, skip_blank=True),
    }


def add_keyword_labels(
    df: DataFrame,
    index: KeywordIndex,
    settings: KeywordSettings = KeywordSettings(),
    segment_rules: bool = False,
    **match_options,
) -> DataFrame:
    """Add the label columns to rows with ``TextColumn``, ``text``, ``is_meaningful`` and ``response_detail``.

    ``segment_rules`` applies the wording used for clauses: any dismissed row is a brief response, whatever its detail.
    """
    flagged_off = F.coalesce(~F.col("is_meaningful"), F.lit(False))
    unflagged_dismissal = F.col("is_meaningful").isNull() & is_dismissive_short(F.col("text"))
    detail = F.col("response_detail")
    has_detail = F.coalesce(detail != "", F.lit(False))
    matched = add_matches(df, index, settings, active=~flagged_off & ~unflagged_dismissal, **match_options)
    if segment_rules:
        brief, brief_detail = flagged_off, F.when(has_detail, detail).otherwise("No")
        brief_reason: Column = F.lit("dismissed")
    else:
        brief, brief_detail = flagged_off & has_detail, detail
        brief_reason = F.concat(F.lit("dismissed:"), detail)
    return out.labels(
        matched, collapse_matches(F.col("matches"), settings), F.col("matches"), brief, F.lit("no_match"),
        brief_detail, brief_reason,
    ).drop("matches")


def assign_keyword(
    long: DataFrame, index: KeywordIndex, settings: KeywordSettings = KeywordSettings(), **match_options
) -> DataFrame:
    """The keyword assignment table, one row per (``ID``, ``TextColumn``)."""
    labelled = add_keyword_labels(long, index, settings, **match_options)
    if not settings.include_dismissed:
        labelled = labelled.filter(F.coalesce(F.col("is_meaningful"), F.lit(True)))
    return labelled.select(*out.COLUMNS)
