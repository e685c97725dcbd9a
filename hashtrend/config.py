"""Window geometry of the indicator engine.

Every length is a whole number of *batches* (slides).  Internally time is an
integer slide index ``slot = floor(epoch_micros / batch_us)``; a window that
ends at index ``e`` covers the half-open interval ``[(e - length) * batch,
e * batch)``, aligned to the epoch like ``pyspark.sql.functions.window``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_UNITS_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def duration_us(text: str | int) -> int:
    """Parse ``"2 seconds"`` / ``"1 hour"`` (or an int of microseconds)."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m.group(2) not in _UNITS_US:
        raise ValueError(f"cannot parse duration {text!r}")
    return int(m.group(1)) * _UNITS_US[m.group(2)]


@dataclass(frozen=True)
class Windows:
    """Batch length plus every other window as a multiple of it.

    Defaults are the reference's: batch 2 s, analytic 32 s (16 slides), half
    16 s (8), reference 512 s (256), recurrent window 120 s (60) every 10 s (5).
    """

    batch: str | int = "2 seconds"
    analytic: int = 16
    half: int = 8
    reference: int = 256
    rec_window: int = 60
    rec_slide: int = 5
    n_features: int = 4

    def __post_init__(self) -> None:
        b = duration_us(self.batch)
        if b <= 0:
            raise ValueError("batch must be positive")
        for name in ("analytic", "half", "reference", "rec_window", "rec_slide"):
            v = getattr(self, name)
            if not isinstance(v, int) or v <= 0:
                raise ValueError(f"{name} must be a positive number of batches, got {v!r}")
        if self.half > self.analytic:
            raise ValueError("half window cannot exceed the analytic window")

    @classmethod
    def from_durations(
        cls,
        batch: str,
        analytic: str,
        reference: str,
        rec_window: str,
        rec_slide: str,
        half: str | None = None,
    ) -> Windows:
        """Build from durations; each must be a whole multiple of ``batch``."""
        b = duration_us(batch)

        def slides(name: str, text: str) -> int:
            us = duration_us(text)
            if us <= 0 or us % b:
                nearest = max(1, round(us / b)) * b / 1_000_000
                raise ValueError(f"{name} = {text!r} is no positive multiple of batch = {batch!r}; nearest: {nearest:g} seconds")
            return us // b

        a = slides("analytic", analytic)
        h = slides("half", half) if half is not None else None
        if h is None:
            if (duration_us(analytic) // 2) % b:
                raise ValueError("half of the analytic window is not a multiple of batch")
            h = a // 2
        return cls(
            batch=b,
            analytic=a,
            half=h,
            reference=slides("reference", reference),
            rec_window=slides("recurrent window", rec_window),
            rec_slide=slides("recurrent slide", rec_slide),
        )

    @property
    def batch_us(self) -> int:
        return duration_us(self.batch)

    @property
    def vector_width(self) -> int:
        return self.rec_window * self.n_features


# Reference configuration (2 s batches) and the test-data configuration: the
# driver tables hold one event every few minutes over 30 days, so the same
# ratios run on 1 h batches.
REFERENCE = Windows()
HOURLY = Windows(batch="1 hour")
