"""hashtrend: hashtag trend indicators on Spark DataFrames (batch and streaming)."""

from hashtrend.config import HOURLY, REFERENCE, Windows

__all__ = ["HOURLY", "REFERENCE", "Windows"]
__version__ = "0.1.0"
