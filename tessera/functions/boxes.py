"""Boxes as four integer columns with a common prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import WORLD_LAT, WORLD_LON

EDGES = ("min_lat", "min_lon", "max_lat", "max_lon")


def box(prefix: str = "") -> dict[str, Column]:
    return {e: F.col(prefix + e) for e in EDGES}


def contains_point(b: dict[str, Column], lat: Column, lon: Column) -> Column:
    """Inclusive on all four edges."""
    return lat.between(b["min_lat"], b["max_lat"]) & lon.between(b["min_lon"], b["max_lon"])


def contains_box(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    return (
        (inner["min_lat"] >= outer["min_lat"]) & (inner["max_lat"] <= outer["max_lat"])
        & (inner["min_lon"] >= outer["min_lon"]) & (inner["max_lon"] <= outer["max_lon"])
    )


def touches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common edges count."""
    return (
        (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"])
        & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])
    )


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common edges do not count."""
    return (
        (a["min_lat"] < b["max_lat"]) & (a["max_lat"] > b["min_lat"])
        & (a["min_lon"] < b["max_lon"]) & (a["max_lon"] > b["min_lon"])
    )


def valid(b: dict[str, Column]) -> Column:
    return (
        (b["min_lat"] <= b["max_lat"]) & (b["min_lon"] <= b["max_lon"])
        & (b["min_lat"] >= -WORLD_LAT) & (b["max_lat"] <= WORLD_LAT)
        & (b["min_lon"] >= -WORLD_LON) & (b["max_lon"] <= WORLD_LON)
    )


def grown(b: dict[str, Column], by: int) -> dict[str, Column]:
    return {e: c - by if e.startswith("min") else c + by for e, c in b.items()}


def at_least_one(b: dict[str, Column]) -> dict[str, Column]:
    """A box without extent gets one unit."""
    return b | {
        "max_lat": F.when(b["max_lat"] == b["min_lat"], b["max_lat"] + 1).otherwise(b["max_lat"]),
        "max_lon": F.when(b["max_lon"] == b["min_lon"], b["max_lon"] + 1).otherwise(b["max_lon"]),
    }


def intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {e: (F.greatest if e.startswith("min") else F.least)(a[e], b[e]) for e in EDGES}


def select_box(b: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + e) for e, c in b.items()]


def union_box(df: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of a group."""
    aggs = [(F.min if e.startswith("min") else F.max)(e).alias(e) for e in EDGES]
    return df.groupBy(*keys).agg(*aggs)
