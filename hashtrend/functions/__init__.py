"""Column-level building blocks (all native Spark expressions, no UDFs)."""

from hashtrend.functions.tags import hashtags, is_delete_notice
from hashtrend.functions.time import end_timestamp, slot_index
from hashtrend.functions.vectors import halving_fold, slot_vector, zero_filled

__all__ = [
    "hashtags",
    "is_delete_notice",
    "slot_index",
    "end_timestamp",
    "halving_fold",
    "slot_vector",
    "zero_filled",
]
