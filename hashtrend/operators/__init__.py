"""DataFrame -> DataFrame operators; each runs on batch frames, and those
without a global step also on streaming frames."""

from hashtrend.operators.extract import co_tags, co_tags_from_pairs, occurrences, slot_pairs, tagged_posts
from hashtrend.operators.indicators import (
    activeness,
    approx_distinct,
    author_panes,
    base_from_panes,
    base_indicators,
    first_degree,
    hot_neighbours,
    neighbour_join,
    sketch_error,
    smoothed_first_degree,
    with_first_degree,
    with_smoothed,
    with_velocity,
)
from hashtrend.operators.panes import PANE_COLUMNS, author_rows, fold_panes, neighbour_rows, pane_rows, post_panes
from hashtrend.operators.report import top_n, top_n_all
from hashtrend.operators.share import delta_share, percent_share, reference_share, slot_totals, total_volume
from hashtrend.operators.vectors import (
    FEATURES,
    assemble_recurrent,
    assemble_vectors,
    feature_vectors,
    recurrent_groups,
    recurrent_vectors,
)
from hashtrend.operators.windowing import bounded_range_frame, hop

__all__ = [
    "FEATURES",
    "PANE_COLUMNS",
    "activeness",
    "approx_distinct",
    "assemble_recurrent",
    "assemble_vectors",
    "author_panes",
    "author_rows",
    "base_from_panes",
    "base_indicators",
    "bounded_range_frame",
    "co_tags",
    "co_tags_from_pairs",
    "delta_share",
    "feature_vectors",
    "first_degree",
    "fold_panes",
    "hop",
    "hot_neighbours",
    "neighbour_join",
    "neighbour_rows",
    "occurrences",
    "pane_rows",
    "percent_share",
    "post_panes",
    "recurrent_groups",
    "recurrent_vectors",
    "reference_share",
    "sketch_error",
    "slot_pairs",
    "slot_totals",
    "smoothed_first_degree",
    "tagged_posts",
    "top_n",
    "top_n_all",
    "total_volume",
    "with_first_degree",
    "with_smoothed",
    "with_velocity",
]
