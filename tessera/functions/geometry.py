"""Exact integer geometry; products stay below 2^51."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_meets_box(y1: Column, x1: Column, y2: Column, x2: Column, b: dict[str, Column]) -> Column:
    """A closed segment and a closed box have a point in common.

    Their boxes meet, and the box's corners are not all strictly on one side of
    the line.
    """
    def side(lat: Column, lon: Column) -> Column:
        return (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)

    corners = [side(b[a].cast("long"), b[o].cast("long")) for a in ("min_lat", "max_lat") for o in ("min_lon", "max_lon")]
    boxes = (
        (F.least(y1, y2) <= b["max_lat"]) & (F.greatest(y1, y2) >= b["min_lat"])
        & (F.least(x1, x2) <= b["max_lon"]) & (F.greatest(x1, x2) >= b["min_lon"])
    )
    return boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def clockwise(points: Column) -> Column:
    """Orientation of a ring ``array<struct<x, y>>`` by its doubled area; without area it counts as clockwise."""
    following = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), following.alias("b"))
    area = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["a"]["x"].cast("long") * p["b"]["y"] - p["b"]["x"].cast("long") * p["a"]["y"])
    return area <= 0


def is_closed(refs: Column) -> Column:
    return (F.size(refs) > 1) & (F.get(refs, F.lit(0)) == F.element_at(refs, -1))
