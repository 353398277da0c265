"""Building a taxonomy as one job: validate the phrase library, stop on errors, write the enriched library and the themes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from verbatim.operators import taxonomy
from verbatim.sources.taxonomy import write_library_rows, write_theme_rows


class TaxonomyErrors(ValueError):
    """The library has errors; ``issues`` lists them as (severity, check, detail, count)."""

    def __init__(self, issues: list[tuple]):
        super().__init__("; ".join(f"{check}: {detail} ({count})" for _, check, detail, count in issues))
        self.issues = issues


@dataclass(frozen=True)
class TaxonomyBuild:
    """``allow_errors`` writes in spite of errors, leaving incomplete rows out; ``validate_only`` writes nothing."""

    min_phrases: int = 2
    allow_errors: bool = False
    validate_only: bool = False

    def run(self, library: DataFrame, folder: str, order: Column | None = None) -> list[tuple]:
        """Write ``folder/enriched`` and ``folder/themes``; returns all issues, a row per check and column at most."""
        issues = [tuple(r) for r in taxonomy.validate_library(library, self.min_phrases).collect()]
        errors = [i for i in issues if i[0] == "error"]
        if errors and not self.allow_errors:
            raise TaxonomyErrors(errors)
        if not self.validate_only:
            write_library_rows(taxonomy.enriched_subthemes(library, order), f"{folder.rstrip('/')}/enriched")
            write_theme_rows(taxonomy.keyword_themes(library), f"{folder.rstrip('/')}/themes")
        return issues
