"""Density grid: nodes per cell, as a sparse table (x, y, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.units import GRID_LAT, round_nearest

#: Blocks of 32 cells a side in the join with boxes.
BLOCK_SHIFT = 5


def data_box(points: DataFrame) -> DataFrame:
    """The box around all points, those beyond 85 degrees included."""
    return points.agg(
        F.min("mlat").alias("min_lat"), F.min("mlon").alias("min_lon"), F.max("mlat").alias("max_lat"), F.max("mlon").alias("max_lon"),
    )


def density(points: DataFrame, shift: int, box: tuple[int, int, int, int]) -> DataFrame:
    """Counts per cell of 2^shift units, from the box's lower corner on.

    The upper edges fall into the last cell; points beyond 85 degrees (rounded to
    the grid) are not counted. One aggregation with partial sums: the shuffle
    carries a row for each cell a task has met.
    """
    min_lat, min_lon, max_lat, max_lon = box
    limit = round_nearest(F.lit(GRID_LAT), shift)
    width, height = max(1, (max_lon - min_lon) >> shift), max(1, (max_lat - min_lat) >> shift)
    inside = F.col("mlat").between(F.greatest(F.lit(min_lat), -limit), F.least(F.lit(max_lat), limit)) & F.col("mlon").between(min_lon, max_lon)
    x = F.least(F.shiftright(F.col("mlon") - min_lon, shift), F.lit(width - 1))
    y = F.least(F.shiftright(F.col("mlat") - min_lat, shift), F.lit(height - 1))
    return points.where(inside).groupBy(x.cast("int").alias("x"), y.cast("int").alias("y")).agg(F.count("*").alias("n"))


def subset(cells: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Cells x0 <= x < x1, y0 <= y < y1, moved to the origin."""
    own = cells.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return own.select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "n")


def sums(cells: DataFrame, axis: str) -> DataFrame:
    """Sums by column (axis x) or row (axis y)."""
    return cells.groupBy(axis).agg(F.sum("n").alias("n"))


def cumulative(cells: DataFrame, axis: str = "x") -> DataFrame:
    """Running sums along an axis. The grid is at most 2^13 wide at the finest usual resolution, so one window is small."""
    s = sums(cells, axis)
    return s.select(axis, F.sum("n").over(W.orderBy(axis)).alias("running"))


def gaps(cells: DataFrame, axis: str = "x") -> DataFrame:
    """Runs of empty columns or rows between filled ones: (start, len)."""
    filled = cells.select(F.col(axis).alias("at")).distinct()
    prev = F.lag("at").over(W.orderBy("at"))
    return filled.withColumn("prev", prev).where("at - prev > 1").select((F.col("prev") + 1).alias("start"), (F.col("at") - F.col("prev") - 1).alias("len"))


def merge_sea(cells: DataFrame, sea: DataFrame) -> DataFrame:
    """Sea counts, doubled, fill cells that are empty."""
    s = sea.select("x", "y", F.col("n").alias("sea"))
    return cells.join(s, ["x", "y"], "full_outer").select("x", "y", F.coalesce("n", F.col("sea") * 2).alias("n"))


def shares(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(share, cells, n): cells grouped by the set of named boxes (in cells, name and four bounds) that cover them.

    Boxes are listed in blocks of cells, so the range join is an equi-join with the exact test as a residual.
    """
    def blocks(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.shiftright(low, BLOCK_SHIFT), F.shiftright(F.col(high) - 1, BLOCK_SHIFT)).cast("array<bigint>"))

    listed = boxes.where("x0 < x1 AND y0 < y1").withColumn("bx", blocks("x0", "x1")).withColumn("by", blocks("y0", "y1"))
    keyed = cells.withColumns({b: F.shiftright(c, BLOCK_SHIFT).cast("long") for b, c in (("bx", "x"), ("by", "y"))})
    cover = keyed.join(listed, ["bx", "by"]).where(F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1))
    per = cover.groupBy("x", "y").agg(F.first("n").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("share"))
    return per.groupBy("share").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))
