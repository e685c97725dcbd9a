"""Sliding-window building blocks on integer slide indices.

``hop`` is the batch form of ``window(ts, length, slide)``: each row is
copied to the ``length`` windows that contain it.  It is applied to
*pre-aggregated panes* (one row per slide and key), never to raw posts, so
the copy factor multiplies the reduced data only.

``bounded_range_frame`` is a ``rangeBetween`` window over a per-key time
series whose partitions stay bounded: the series is cut into chunks of
``chunk`` slides and the last ``span - 1`` slides of each chunk are copied
into the next one as a halo.  A hot key with a long history is then spread
over many tasks instead of landing in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hop(df: DataFrame, idx_col: str, length: int, *, shift: int = 1, out: str = "w_idx") -> DataFrame:
    """Copy each row to the windows ending at ``idx + shift … idx + shift + length - 1``.

    ``shift=1`` for slots (a slot ``s`` lies in windows ending ``s+1 … s+length``);
    ``shift=0`` for rows that are themselves window results indexed by their
    end, re-windowed over the slides ending in ``(e - length, e]``.  The copy
    offset is ``out - idx - shift``.  One ``select``: a long chain of
    ``withColumn`` calls costs analysis time on every step.
    """
    start = F.col(idx_col) + F.lit(shift)
    return df.select("*", F.explode(F.sequence(start, start + F.lit(length - 1))).alias(out))


def with_first_cover(
    df: DataFrame, keys: list[str], slot_col: str, length: int, out: str, *, chunk: int | None = None
) -> DataFrame:
    """Add ``out``: offset of the first window a slot row is the *earliest* member of.

    Rows are distinct per ``(keys, slot)``.  With ``prev`` the key's previous
    slot, the windows ending ``slot+1 … prev+length`` already hold ``prev``; the
    row is the earliest member of the key only in windows at offsets ``>= prev
    + length - slot`` (offsets as in :func:`hop`).  Copying each row to those
    windows only yields every ``(window, key)`` exactly once, so distinct
    counts over a sliding window become plain sums, with no distinct
    aggregate and no shuffle on the distinct value.  Only a ``prev`` within
    ``length - 1`` slides matters, so the lag runs per key and chunk of slides
    with that halo: a key that is there in every slide of a long history is
    ``chunk`` rows a task, not all of them.
    """
    staged = chunk_copies(df, slot_col, length, chunk or default_chunk(length))
    prev = F.lag(slot_col).over(Window.partitionBy(*keys, "_chunk").orderBy(slot_col))
    offset = F.greatest(F.lit(0), F.coalesce(prev + F.lit(length) - F.col(slot_col), F.lit(0))).cast("int")
    placed = staged.select(*df.columns, "_home", "_chunk", offset.alias(out))
    return placed.where(F.col("_chunk") == F.col("_home")).select(*df.columns, out)


def hop_first_cover(
    df: DataFrame, keys: list[str], slot_col: str, length: int, *, out: str = "w_idx", chunk: int | None = None
) -> DataFrame:
    """Distinct ``(window, keys)`` from distinct ``(slot, keys)`` rows."""
    cols = df.columns
    staged = with_first_cover(df, keys, slot_col, length, "_off", chunk=chunk)
    slot = F.col(slot_col)
    ends = F.sequence(slot + F.lit(1) + F.col("_off"), slot + F.lit(length))
    return staged.select(*cols, F.explode(ends).alias(out))


def default_chunk(span: int) -> int:
    return max(16 * span, 4096)


def chunk_copies(df: DataFrame, idx_col: str, span: int, chunk: int) -> DataFrame:
    """Add ``_home`` (chunk of the row) and ``_chunk`` (chunk it is placed in):
    a row is placed in its own chunk and, when within ``span - 1`` slides of
    the chunk's end, copied into the next one as halo.  A frame reaching
    ``span - 1`` slides back is then complete inside ``(keys, _chunk)`` for
    every row with ``_chunk == _home``."""
    if chunk < span:
        raise ValueError("chunk must be at least the frame span")
    idx = F.col(idx_col)
    home = F.call_function("div", idx, F.lit(chunk).cast("long"))
    in_halo = (idx - home * F.lit(chunk)) >= F.lit(chunk - (span - 1))
    copies = F.when(in_halo, F.array(home, home + 1)).otherwise(F.array(home))
    return df.select("*", home.alias("_home"), F.explode(copies).alias("_chunk"))


def bounded_range_frame(
    df: DataFrame,
    keys: list[str],
    idx_col: str,
    span: int,
    columns: Callable[[Window], dict[str, Column]],
    *,
    chunk: int | None = None,
) -> DataFrame:
    """Add ``columns(w)`` computed over ``w = partitionBy(keys).orderBy(idx)
    .rangeBetween(-(span - 1), 0)``, exactly, with bounded partitions."""
    chunk = chunk or default_chunk(span)
    staged = chunk_copies(df, idx_col, span, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx_col).rangeBetween(-(span - 1), 0)
    added = columns(w)
    out = staged.select(*df.columns, "_home", "_chunk", *[c.alias(n) for n, c in added.items()])
    return out.where(F.col("_chunk") == F.col("_home")).select(*df.columns, *added)
