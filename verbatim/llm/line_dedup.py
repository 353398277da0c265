"""Lines that many documents share, removed by levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that hold the line, dealt and sorted by hash. Documents come in
batches. Each batch counts its own lines, is merge-anti-joined with the lines that the runs already know to be frequent, and
adds the rest as a run of level 0. Whenever a level holds ``fanout`` runs, they are merged into one run of the next level, and
keys that have reached the threshold by then move to a run of frequent ones, so a batch meets few runs, whatever the
number of batches before it. Document counts add up over runs, therefore the batches' order and number change nothing.

A line's key is the line without white space at its ends, A-Z lower-cased; 128 bits of hash stand for it. Lines are counted
once per document and combined before the shuffle. To drop lines, the lines of the documents meet the frequent keys by a
merge join; keys that hold more than 1/65,536 of all lines (so at most 65,536 keys) are broadcast and never gather in one task. Only
hashes and positions travel there; texts are shuffled once, to meet their positions.

Defined results: a null text and an empty one are one empty line; keys shorter than ``min_chars`` code points are never
dropped, so blank lines stay; a document is a row, so repeated rows count each; null ids are ids like others; an empty table
gives an empty table; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_all, explode_rows
from verbatim.llm.common import SPACES, drop_stored, free_name, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Keys above this share of all lines are broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 65_536
SALTS = 64
#: Types of columns that a row's hash is taken of.
PLAIN = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date", "timestamp", "double", "float", "binary")


@dataclass(frozen=True)
class LineDedup:
    """``min_docs`` documents make a line frequent; ``batches`` parts of a corpus; ``fanout`` runs fill a level."""

    min_docs: int = 10
    min_chars: int = 1
    batches: int = 4
    fanout: int = 2


def keys_of(text: Column) -> Column:
    """The key of each line."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def hashes(*values: Column | str) -> list[Column]:
    """Two independent hashes of 64 bits."""
    return [F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit("line"), *values).alias("h2")]


def counted_lines(docs: DataFrame, text: str, settings: LineDedup) -> DataFrame:
    """(h1, h2, n): documents per key; a document counts once for a key."""
    keys = F.array_distinct(F.filter(keys_of(F.col(f"`{text}`")), lambda k: F.char_length(k) >= settings.min_chars))
    lines = explode_rows(docs, [], keys, "k").select(*hashes("k"))
    return lines.groupBy(*KEY).agg(F.count("*").alias("n"))


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs as one: equal keys add up."""
    total = runs[0]
    for run in runs[1:]:
        total = total.unionByName(run)
    return total.groupBy(*KEY).agg(F.sum("n").alias("n")) if len(runs) > 1 else total


@dataclass
class LineRuns:
    """The levels of runs, the runs of frequent keys and the hot keys of each batch: tables in the shared folder."""

    spark: SparkSession
    settings: LineDedup = field(default_factory=LineDedup)
    levels: list[list[DataFrame]] = field(default_factory=list)
    frequent: list[DataFrame] = field(default_factory=list)
    hot: list[DataFrame] = field(default_factory=list)

    def written(self, keys: DataFrame, name: str) -> DataFrame:
        """A run: the grouping has dealt the keys by hash, each part is sorted."""
        return stored(keys.sortWithinPartitions(*KEY), name)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """One batch of documents: count, take out what is known to be frequent, add the rest."""
        batch = self.written(counted_lines(docs, text, self.settings), "batch")
        total = batch.agg(F.sum("n")).first()[0] or 0
        # A key above the share in the corpus is above it in one batch at least, and a batch has few of those.
        self.hot.append(stored(batch.filter(F.col("n") > F.lit(total * HOT_SHARE)).select(*KEY), "hot"))
        if self.frequent:
            run = self.written(batch.join(self.known().hint("merge"), KEY, "left_anti"), "run")
            drop_stored(self.spark, batch)
            batch = run
        self.push(batch, 0)

    def push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.settings.fanout:
            old, self.levels[level] = self.levels[level], []
            both = stored(merged(old), "compacted")
            enough = F.col("n") >= self.settings.min_docs
            self.frequent.append(self.written(both.filter(enough), "frequent"))
            self.push(self.written(both.filter(~enough), "run"), level + 1)
            drop_stored(self.spark, both, *old)

    def known(self) -> DataFrame:
        """Keys that a compaction has found frequent. Each is in one run only, as later batches leave it out."""
        found = self.frequent[0]
        for run in self.frequent[1:]:
            found = found.unionByName(run)
        return found.select(*KEY)

    def all_frequent(self) -> DataFrame:
        """(h1, h2) of every key that at least ``min_docs`` documents hold, over all runs."""
        none = self.spark.range(0).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("n"))
        open_runs = [run for level in self.levels for run in level]
        found = merged(open_runs or [none]).filter(F.col("n") >= self.settings.min_docs).select(*KEY)
        return found.unionByName(self.known()) if self.frequent else found

    def all_hot(self) -> DataFrame:
        """(h1, h2) of the keys above ``HOT_SHARE`` in any batch: at most its inverse per batch."""
        found = self.spark.range(0).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
        for keys in self.hot:
            found = found.unionByName(keys)
        return found.distinct()

    def close(self) -> None:
        """Remove the tables; nothing that reads them may be left."""
        drop_stored(self.spark, *self.frequent, *self.hot, *(run for level in self.levels for run in level))
        self.levels, self.frequent, self.hot = [], [], []


def build_runs(docs: DataFrame, text: str = "text", settings: LineDedup | None = None) -> LineRuns:
    """The runs of a whole corpus, dealt into batches by the hash of its rows."""
    runs = LineRuns(docs.sparkSession, settings or LineDedup())
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in PLAIN]
    batch = F.pmod(F.xxhash64(*plain), F.lit(runs.settings.batches))
    for i in range(runs.settings.batches):
        runs.add(docs.filter(batch == i), text)
    return runs


def without_positions(lines: Column, gone: Column) -> Column:
    """The lines outside the sorted positions ``gone``: the slices between them, so the work is linear in the text."""

    def span(end: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
        return F.slice(lines, before + F.lit(2), end - before - F.lit(1))

    return F.flatten(F.transform(F.concat(gone, F.array(F.size(lines))), span))


def drop_frequent(docs: DataFrame, runs: LineRuns, text: str = "text") -> DataFrame:
    """``docs`` without the lines of frequent keys, plus ``n_lines`` and ``n_dropped`` (renamed if such columns exist).

    Rows are told apart by 128 bits of hash over their values; equal rows lose the same lines.
    """
    names, types = list(docs.columns), dict(docs.dtypes)
    n_lines = free_name(names, "n_lines")
    n_dropped = free_name(names, "n_dropped")
    r1, r2 = hashes(*[F.col(f"`{c}`") for c in names if types[c] in PLAIN])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], r1.alias("r1"), r2.alias("r2"))
    body = F.col(f"c{names.index(text)}")

    lines = explode_rows(rows, ["r1", "r2"], keys_of(body), "k", "pos")
    lines = lines.filter(F.char_length("k") >= runs.settings.min_chars).select("r1", "r2", "pos", *hashes("k"))
    # A hot key meets its many lines in SALTS places.
    hot = F.broadcast(runs.all_hot().withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod("r1", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    lines = lines.join(hot, KEY, "left").withColumn("salt", salt).drop("hot")
    salts = F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    keys = runs.all_frequent().join(hot, KEY, "left").select(*KEY, F.explode(salts).alias("salt"))
    gone = lines.join(keys.hint("merge"), [*KEY, "salt"], "left_semi")
    gone = gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    out = rows.join(gone, ["r1", "r2"], "left").drop("r1", "r2")
    out = out.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    out = compute_all(out, {"lines": F.split(F.coalesce(body, F.lit("")), "\n")})
    left = F.array_join(without_positions(F.col("lines"), F.col("gone")), "\n")
    cleaned = F.when(F.size("gone") == 0, body).otherwise(left)
    return out.select(
        *[(cleaned if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
        F.size("lines").cast("long").alias(n_lines),
        F.size("gone").cast("long").alias(n_dropped),
    )


def dedup_lines(docs: DataFrame, text: str = "text", settings: LineDedup | None = None) -> DataFrame:
    """All documents, each without the lines that ``min_docs`` documents share."""
    return drop_frequent(docs, build_runs(docs, text, settings), text)
