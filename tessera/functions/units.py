"""Map units: 2^24 to the full circle. All functions take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD_LAT = 0x400000
WORLD_LON = 0x800000
#: 85 degrees in map units, beyond which nothing is counted in a density grid.
GRID_LAT = 3961287


def to_map_unit(degrees: Column) -> Column:
    """Half away from zero; a cast truncates, so half a unit is added outwards first."""
    half = F.lit(180.0 / (1 << 24))
    outward = F.when(degrees > 0, degrees + half).otherwise(degrees - half)
    return (outward * float(1 << 24) / 360.0).cast("int")


def to_degrees(units: Column) -> Column:
    return F.lit(360.0) * units / float(1 << 24)


def round_down(v: Column, shift: int) -> Column:
    """Floor to a multiple of 2^shift, for negative numbers too."""
    return F.shiftleft(F.shiftright(v, shift), shift)


def round_up(v: Column, shift: int) -> Column:
    return round_down(v + ((1 << shift) - 1), shift)


def round_nearest(v: Column, shift: int) -> Column:
    """Half upwards; the identity for shift 0."""
    return round_down(v + ((1 << shift) >> 1), shift)


def alignment(resolution: int) -> int:
    """Edge of a grid cell in map units."""
    return 1 << (24 - resolution)


def round_box(box: dict[str, Column], resolution: int) -> dict[str, Column]:
    """A box grown to the grid, kept within 85 degrees of latitude and the world's longitudes."""
    shift = 24 - resolution
    low, high = F.lit(-GRID_LAT), F.lit(GRID_LAT)
    return {
        "min_lat": round_down(F.greatest(box["min_lat"], low), shift),
        "min_lon": F.greatest(round_down(box["min_lon"], shift), F.lit(-WORLD_LON)),
        "max_lat": round_up(F.least(box["max_lat"], high), shift),
        "max_lon": F.least(round_up(box["max_lon"], shift), F.lit(WORLD_LON)),
    }


def tile_name(map_id: Column) -> Column:
    return F.lpad(map_id.cast("string"), 8, "0")
