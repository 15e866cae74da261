"""What a map shows at a zoom level."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators.rows import detail_limit, detail_min_mentions, grid_digits, map_details
from newsloom.operators.trends import map_grid
from newsloom.plans.filters import EventFilter


def map_view(
    events: DataFrame,
    box: dict[str, float],
    zoom: float,
    f: EventFilter,
    places: DataFrame | None = None,
) -> tuple[bool, DataFrame]:
    """Grid cells (True) below zoom 9, single events (False) from there on."""
    digits = grid_digits(zoom)
    if digits is not None:
        return True, map_grid(events, box, f, digits, places)
    shown = f.with_(limit=detail_limit(zoom, f.limit))
    return False, map_details(events, box, shown, detail_min_mentions(zoom), places)
