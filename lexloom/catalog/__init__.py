"""All registered queries. Importing the modules registers them."""

from . import analytics, conversation, corpus, retrieval, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
