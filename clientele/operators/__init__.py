"""Distributed building blocks that Spark has no single operator for."""

from clientele.operators.bands import Banding, assign_bands
from clientele.operators.inserts import insert_ignore, keep_first
from clientele.operators.sequences import ordered_history, range_cuts
from clientele.operators.settling import chunk_count, discard_settled, settle, settled_so_far

__all__ = [
    "Banding",
    "assign_bands",
    "chunk_count",
    "discard_settled",
    "insert_ignore",
    "keep_first",
    "ordered_history",
    "range_cuts",
    "settle",
    "settled_so_far",
]
