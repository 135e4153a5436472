"""All registered queries and their SQL."""

from __future__ import annotations

from alertloom.plans import datasets, decisions, files, labeling, lexical, metrics, streams, texts

MODULES = (metrics, labeling, datasets, texts, decisions, lexical, files, streams)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
