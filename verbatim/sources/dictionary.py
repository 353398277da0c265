"""The text dictionary: replacement maps, forced phrases and word lists."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

DICTIONARY_SCHEMA = "kind string, pos int, key string, value string"


@dataclass(frozen=True)
class TextDictionary:
    business_map: Mapping[str, str] = field(default_factory=dict)
    merge_map: Mapping[str, str] = field(default_factory=dict)
    force_phrases: tuple[str, ...] = ()
    unigram_whitelist: frozenset[str] = frozenset()
    always_drop: frozenset[str] = frozenset()
    must_be_phrase: frozenset[str] = frozenset()

    @classmethod
    def from_config(cls, config: Mapping, block_list_drops: bool = False) -> TextDictionary:
        """Build from a parsed dictionary file; everything is lower-cased and three whitelists are united.

        ``block_list_drops`` also adds the ``ALWAYS_BLOCK`` list to the dropped words, as word counting does.
        """

        def mapping(name: str) -> dict[str, str]:
            return {str(k).lower(): str(v).lower() for k, v in (config.get(name) or {}).items()}

        def words(*names: str) -> frozenset[str]:
            return frozenset(str(x).lower() for name in names for x in (config.get(name) or []))

        return cls(
            business_map=mapping("BUSINESS_MAP"),
            merge_map=mapping("MERGE_TO_CANONICAL"),
            force_phrases=tuple(str(x).lower() for x in (config.get("FORCE_PHRASES") or [])),
            unigram_whitelist=words("UNIGRAM_WHITELIST", "DOMAIN_WHITELIST", "ACCRONYM_WHITELIST"),
            always_drop=words("ALWAYS_DROP_UNIGRAMS", *(["ALWAYS_BLOCK"] if block_list_drops else [])),
            must_be_phrase=words("MUST_BE_PHRASE"),
        )

    def rows(self) -> list[Row]:
        out: list[tuple] = []
        for kind, entries in (("business", self.business_map), ("merge", self.merge_map)):
            out += [(kind, i, k, v) for i, (k, v) in enumerate(entries.items())]
        out += [("force", i, k, None) for i, k in enumerate(self.force_phrases)]
        for kind, entries in (
            ("keep", self.unigram_whitelist), ("drop", self.always_drop), ("must", self.must_be_phrase),
        ):
            out += [(kind, i, k, None) for i, k in enumerate(sorted(entries))]
        return [Row(kind=k, pos=p, key=key, value=v) for k, p, key, v in out]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per entry, so that a dictionary can be kept as a table."""
        return spark.createDataFrame(self.rows(), DICTIONARY_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame, max_entries: int = 100_000) -> TextDictionary:
        """Read a dictionary table back. Dictionaries become literals in the plan, so their size is checked."""
        rows = df.orderBy("kind", "pos").limit(max_entries + 1).collect()
        if len(rows) > max_entries:
            raise ValueError(f"a text dictionary holds at most {max_entries} entries")

        def keys(kind: str) -> list[str]:
            return [r["key"] for r in rows if r["kind"] == kind]

        def mapping(kind: str) -> dict[str, str]:
            return {r["key"]: r["value"] for r in rows if r["kind"] == kind}

        return cls(
            mapping("business"), mapping("merge"), tuple(keys("force")),
            frozenset(keys("keep")), frozenset(keys("drop")), frozenset(keys("must")),
        )


def read_dictionary(path: str, block_list_drops: bool = False) -> TextDictionary:
    """Read a dictionary YAML file; a missing file gives an empty dictionary."""
    from verbatim.sources.files import read_yaml

    return TextDictionary.from_config(read_yaml(path, missing_ok=True), block_list_drops)
