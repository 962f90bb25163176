"""Queries over the driver's tables, one or more for each group of operators, and their SQL."""

from quillstone.plans import access, corpora, files, flows, messages, replies, retrieval, runs, streams, texts, verdicts  # noqa: F401
from quillstone.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
