"""Queries over the given tables, grouped by topic; importing this package registers them all."""

from answerloom.queries import corpus, lengths, metrics, prompts, quality, runs, sampling, text
from answerloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "lengths", "metrics", "prompts", "quality", "runs", "sampling", "text"]
