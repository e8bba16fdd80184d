"""Registered queries by topic; importing this package fills the registry."""

from . import answering, corpus, evaluation, ingestion, records, retrieval, texts, workflows  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
