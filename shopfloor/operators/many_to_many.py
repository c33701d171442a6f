"""Many-to-many joins summarised on one side instead of expanded.

Joining every use of a part with every purchase of that part multiplies the
two row counts per part; a part that appears in a third of both facts makes
the output quadratic in the data. The questions that do this only need,
per row of one side, facts about the matching rows of the other side
(how many, earliest/latest, sums). Those are aggregated per join key first —
a hash aggregate with map-side partial aggregation, one row per key — and
then joined to the other side, so the output is linear in the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from shopfloor.operators.hot_keys import checked_unique, salted_join


def summarise_matches(
    left: DataFrame,
    right: DataFrame,
    key: str,
    aggs: Sequence[Column],
    how: str = "inner",
    right_extra: DataFrame | None = None,
) -> DataFrame:
    """Each ``left`` row joined with ``aggs`` over the ``right`` rows sharing ``key``.

    With ``how='inner'`` left rows without a match are dropped, as in an inner
    many-to-many join; ``how='left'`` keeps them with NULL summaries.
    ``right_extra`` (one row per key, e.g. a dimension) is attached to the
    per-key summaries first, so the large side is joined once; a second row for a key fails the
    query. That join spreads every key (:func:`~shopfloor.operators.hot_keys.salted_join`).
    """
    per_key = right.groupBy(key).agg(*aggs)
    if right_extra is not None:
        per_key = per_key.join(checked_unique(right_extra, key), key, "inner" if how == "inner" else "left")
    return salted_join(left, per_key, key, how, unique=False)  # one row a key by now
