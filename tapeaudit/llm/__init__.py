"""Operators for training-data pipelines: deduplication, language, scoring, decontamination, tokens, shards, archives."""

from .queries import ORACLES, QUERIES  # noqa: F401
