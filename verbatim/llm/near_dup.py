"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Every permutation of the hashed set gives two signature values, its minimum
and its maximum, so a signature of n values costs n / 2 evaluations per shingle; both estimate the Jaccard similarity
without bias and, being negatively correlated, with less variance than n separate minima. Bands of the signature bring
candidates together, and links are confirmed on the full sets.

No rows are made for all pairs of a group of copies. Documents with equal sets are one class from the start. Every bucket of
a band compares its members with its smallest one, its pivot, only. What that leaves open is a member outside of the pivot's
component, and whether it is linked to another member: to one of the pivot's component, unless the distances to the pivot
rule that out by the triangle inequality of the Jaccard distance, or to another outsider. Such outsiders are asked once per
component, not per bucket, against blocks of its members, in tasks that hold some hundred sets on either side. So every pair of
different sets that shares a band is linked, connected otherwise, or shown not to be a link.

Components come from alternating star contraction: rounds of joins and groupings, logarithmic in the size of a
component, each written to the shared folder.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words than
a shingle has one shingle, all its words; rows with one id count as one document for links; a row without an id takes the
component of its set, or stays alone; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatim.llm.common import drop_stored, free_name, stored

#: Upper to lower case for A to Z only, as a byte table.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
REMEMBERED = 400_000


@dataclass(frozen=True)
class NearDup:
    """A link: ``100 * intersection >= percent * union``.

    With 36 bands of 5, a pair at similarity 0.8 shares no band with probability 6e-7; at 0.3, it shares one in 8 % of cases.
    """

    words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    seed: int = 20240229

    @property
    def permutations(self) -> int:
        return -(-self.bands * self.rows // 2)


class WordHash(dict):
    """A word's 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


@lru_cache(maxsize=1)
def word_hash() -> WordHash:
    return WordHash()


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int):
    """The sorted distinct 64-bit shingle hashes of a text."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hash().__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = _mixed(out) + h[j : len(h) - k + 1 + j]
    return np.unique(_mixed(out + np.uint64(k)))


@lru_cache(maxsize=4)
def multipliers(config: NearDup):
    import numpy as np

    rng = np.random.default_rng(config.seed)
    return rng.integers(0, 2**63, (config.permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(shingles, config: NearDup):
    """The signature: the minima under all permutations, then the maxima. A permutation is an odd factor modulo 2**64."""
    import numpy as np

    factors = multipliers(config)
    low = high = None
    for at in range(0, len(shingles), 1024):
        product = factors * shingles[at : at + 1024]
        a, b = product.min(axis=1), product.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(signature, config: NearDup):
    """One 64-bit key per band; a band takes neighbours, so its values come from different permutations."""
    import numpy as np

    values = signature[: config.bands * config.rows].reshape(config.bands, config.rows)
    key = np.arange(1, config.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(config.rows):
        key = _mixed(key + values[:, j])
    return key.view(np.int64)


def _signed(config: NearDup):
    """Map batches of (id, text) to id, n_shingles, digest of the set, band keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sizes, digests, keys, ends = [], [], [], [0]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), config.words)
                sizes.append(len(s))
                if len(s):
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(min_max(s, config), config))
                else:
                    digests.append(None)
                ends.append(ends[-1] + (config.bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["id", "n_shingles", "digest", "keys"],
            )

    return run


def _sets(config: NearDup):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), config.words).view("int64") for t in part.column(1)]
                column = pa.array(sets, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], ["id", "shingles"])

    return run


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


#: Bits of a map of ids, whatever their number: 2 ** 18 rows of 64, some 4 MB to broadcast.
MAP_ROWS = 1 << 18


def among(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a flag ``name``: false for rows whose ``key`` is surely not in ``ids`` (column id).

    The ids set bits in a map of fixed size, which is broadcast, so that texts nobody asks for need no shuffle. The more
    ids, the more rows are flagged in vain; an exact join decides about flagged rows.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_ROWS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{c}`, 1), 64) as int))")
    bits = ids.select(place(F.col("id")).alias("place"), bit("id").alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    row, taken = free_name(rows.columns, "map_place"), free_name(rows.columns, "map_bits")
    bits = bits.select(F.col("place").alias(row), F.col("bits").alias(taken))
    flagged = rows.withColumn(row, place(F.col(key))).join(F.broadcast(bits), row, "left")
    flag = F.coalesce(F.col(taken).bitwiseAND(bit(key)) != 0, F.lit(False))
    return flagged.select(*[F.col(f"`{c}`") for c in rows.columns], flag.alias(name))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with ``shared`` and ``union``, the sizes of intersection and union of the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return out.select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("union"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) for the ends of ``edges`` (columns a < b), by alternating star contraction."""
    spark = edges.sparkSession
    edges = stored(edges.select("a", "b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = edges.join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: smaller neighbours, and the node itself, move to the smallest.
        large = stored(large, "large-star")
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(floor, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        small = small.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = stored(small, "small-star")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(spark, edges, large)
        edges = new
        if mark == state or mark[0] == 0:
            break
        state = mark
    out = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return out.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def candidates(signed: DataFrame) -> DataFrame:
    """Rows (key, id, pivot) of all buckets with two or more classes; the pivot is the smallest id."""
    rows = signed.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    return rows.join(buckets.select("key", "pivot"), "key")


def classes(docs: DataFrame, config: NearDup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``id``, ``n_shingles``, ``component`` (the smallest id it is linked to, through others or not)."""
    config = config or NearDup()
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    id_type = _type(slim, "id")
    schema = f"id {id_type}, n_shingles bigint, digest binary, keys array<bigint>"
    signed = stored(slim.mapInArrow(_signed(config), schema), "signatures")
    firsts = signed.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    firsts = stored(firsts, "classes")
    one = signed.join(firsts, "digest").filter("id = first").dropDuplicates(["id", "digest"])
    members = stored(candidates(one.select("id", "keys")), "members")
    stars = members.filter("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = stored(stars, "stars")
    wanted = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    found = among(slim, wanted, "id", "asked").filter("asked").drop("asked")
    found = found.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    sets = stored(found.mapInArrow(_sets(config), f"id {id_type}, shingles array<bigint>"), "sets")
    judged = stored(verified(stars, sets), "judged")
    link = f"100 * shared >= {config.percent} * union"
    first_links = judged.filter(link).select("a", "b")
    near = stored(components(first_links), "near")
    questions = stored(open_questions(members, judged, near, config), "questions")
    if not questions.isEmpty():
        more = block_links(questions, near, sets, config)
        near = stored(components(first_links.unionByName(more)), "near-all")
    out = signed.select("id", "n_shingles", "digest").join(firsts, "digest", "left")
    out = out.join(near.withColumnRenamed("id", "first"), "first", "left")
    drop_stored(spark, members, stars, sets, judged, questions)
    return out.select("id", "n_shingles", F.coalesce("component", "first", "id").alias("component"))


def open_questions(members: DataFrame, judged: DataFrame, near: DataFrame, config: NearDup) -> DataFrame:
    """Rows (home, id, against_home, against_others): what the stars leave to ask of each bucket's outsiders.

    An outsider is a member that lies in another component than the bucket's pivot. It may still be linked to a member of the
    pivot's component, unless all of those are nearer to the pivot than the triangle inequality demands, and to another
    outsider. One row per outsider and home component, however many buckets they share.
    """
    gap = 1 - config.percent / 100
    far = (1 - F.col("shared") / F.col("union")).alias("far")
    labels = near.select(F.col("id").alias("x"), "component")
    rows = members.join(judged.select(F.col("a").alias("pivot"), F.col("b").alias("id"), far), ["pivot", "id"], "left")
    rows = rows.join(labels, rows["id"] == labels["x"], "left")
    rows = rows.select("key", "id", F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("component", "id").alias("component"))
    pivot = labels.select(F.col("x").alias("pivot"), F.col("component").alias("home"))
    homes = members.select("key", "pivot").distinct().join(pivot, "pivot", "left").select("key", F.coalesce("home", "pivot").alias("home"))
    rows = stored(rows.join(homes, "key"), "mixed")
    inside = F.col("component") == F.col("home")
    mixed = rows.groupBy("key").agg(
        F.max(F.when(inside, F.col("far"))).alias("reach"),
        F.min(F.when(~inside, F.col("component"))).alias("c1"),
        F.max(F.when(~inside, F.col("component"))).alias("c2"),
    )
    asked = rows.filter(~inside).join(mixed.filter("c1 is not null"), "key")
    asked = asked.select(
        "home", "id", (F.col("far") <= F.col("reach") + (gap + 1e-9)).alias("against_home"), (F.col("c1") < F.col("c2")).alias("against_others")
    )
    asked = asked.filter("against_home or against_others").groupBy("home", "id")
    return asked.agg(F.max("against_home").alias("against_home"), F.max("against_others").alias("against_others"))


def _links(config: NearDup):
    """Two tables (.., id, shingles) to the links between their rows, through an inverted index of the first."""
    import pyarrow as pa

    def run(targets: pa.Table, probes: pa.Table) -> pa.Table:
        import numpy as np

        ids, asked = targets.column("id").to_pylist(), probes.column("id").to_pylist()
        out: dict[str, list] = {"a": [], "b": []}
        if ids and asked:
            sets = targets.column("shingles").combine_chunks()
            size = sets.value_lengths().to_numpy()
            values = sets.flatten().to_numpy()
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(ids)), size)[order]
            for probe, own in zip(asked, probes.column("shingles"), strict=True):
                own = own.values.to_numpy()
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = high - low
                places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[places], minlength=len(ids))
                for i in np.flatnonzero(100 * shared >= config.percent * (size + len(own) - shared)).tolist():
                    if ids[i] != probe:
                        out["a"].append(min(ids[i], probe))
                        out["b"].append(max(ids[i], probe))
        kind = targets.schema.field("id").type
        return pa.table({c: pa.array(v, kind) for c, v in out.items()})

    return run


#: Sets that meet in one task: so many of a home component, so many that ask.
BLOCK, ASKING = 512, 1024


def block_links(questions: DataFrame, near: DataFrame, sets: DataFrame, config: NearDup) -> DataFrame:
    """Links (a, b) that answer the questions: each home and its outsiders are dealt into blocks that meet in a grid."""
    homes = questions.filter("against_home").select("home").distinct()
    targets = near.select(F.col("component").alias("home"), "id").join(homes, "home")
    targets = targets.unionByName(questions.filter("against_others").select("home", "id")).distinct()
    probes = questions.select("home", "id")
    grid = targets.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    grid = grid.join(probes.groupBy("home").agg(F.ceil(F.count("*") / ASKING).cast("long").alias("lots")), "home")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = targets.join(grid, "home").select("home", "id", dealt("blocks").alias("block"), every("lots").alias("lot"))
    right = probes.join(grid, "home").select("home", "id", every("blocks").alias("block"), dealt("lots").alias("lot"))
    keys = ["home", "block", "lot"]
    # Written and read again: both sides come from the same tables, and their columns must be told apart.
    asking = stored(right.join(sets, "id"), "asking")
    kind = _type(sets, "id")
    links = left.join(sets, "id").groupBy(*keys).cogroup(asking.groupBy(*keys))
    return links.applyInArrow(_links(config), f"a {kind}, b {kind}").distinct()


def keep_one(docs: DataFrame, config: NearDup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, its smallest id, all columns as they came. Rows without an id stay."""
    gone = classes(docs, config, key, text).filter("id != component").select("id").distinct()
    gone = stored(gone, "near-copies")
    flag = free_name(docs.columns, "maybe")
    flagged = among(docs, gone, key, flag)
    name = free_name(docs.columns, "gone")
    asked = flagged.filter(flag).drop(flag).join(gone.withColumnRenamed("id", name), F.col(key) == F.col(name), "left_anti")
    return flagged.filter(~F.col(flag)).drop(flag).unionByName(asked)
