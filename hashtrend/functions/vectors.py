"""Array expressions for reference share folding and vector assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halving_fold(values: Column) -> Column:
    """Fold ``acc = (acc + x) / 2`` over an array of doubles, first to last.

    Meant for ``collect_list(x).over(w)`` with ``w`` ordered by time: a window
    frame feeds its rows to the aggregate in the window's ORDER BY order, so
    the array is already oldest first (sorting it again costs 3-8x).
    """
    first = F.try_element_at(values, F.lit(1)).cast("double")
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda acc, x: (acc + x) / F.lit(2.0))


def zero_filled(cols: list[Column]) -> Column:
    """Dense ``array<double>`` with absent (null) metrics as 0.0."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def slot_vector(entries: Column, n_slots: int, width: int, pos: str = "pos", value: str = "features") -> Column:
    """Concatenate ``n_slots`` slot vectors oldest first; missing slots are zeros.

    ``entries`` is an array of ``struct(pos, features)`` with distinct ``pos``
    (at most ``n_slots`` of them).  Each slot is found with ``array_position``
    over the entries' positions (a compiled scan) rather than a map, whose
    construction hashes every key to check duplicates, or a per-slot
    ``filter``, which runs a lambda per entry.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    positions = F.transform(entries, lambda e: e[pos])
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_slots - 1)),
            lambda i: F.coalesce(F.get(entries, F.array_position(positions, i).cast("int") - 1)[value], zeros),
        )
    )
