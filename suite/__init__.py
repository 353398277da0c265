"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["q_text", "q_quality", "q_match", "q_sentiment", "q_reports", "q_taxonomy", "q_profile"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"suite.{name}")


def queries() -> dict:
    _load()
    from suite.registry import QUERIES

    return dict(QUERIES)


def twins() -> dict[str, str]:
    _load()
    from suite.registry import TWINS

    return dict(TWINS)
