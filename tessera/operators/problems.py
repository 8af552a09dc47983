"""Elements whose parts lie in more than one working area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problem_ways(tiles_of_ways: DataFrame) -> DataFrame:
    """(way) in more than one area; the input is distinct, so a count will do."""
    return tiles_of_ways.groupBy("way").agg(F.count("*").alias("n")).where("n > 1").select("way")


def relation_areas(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """(rel, tile) of wanted relations."""
    return tiles.join(wanted.select("rel"), "rel", "left_semi")


def problem_relations(areas: DataFrame) -> DataFrame:
    return areas.groupBy("rel").agg(F.count("*").alias("n")).where("n > 1").select("rel")


def single_area_relations(areas: DataFrame) -> DataFrame:
    """(rel, tile) of relations that lie in exactly one area."""
    return areas.groupBy("rel").agg(F.count("*").alias("n"), F.min("tile").alias("tile")).where("n = 1").select("rel", "tile")


def report(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(line) of the problem report, ways before relations, by id."""
    parts = [f.select(F.lit(i).alias("part"), F.col(key).alias("id"), F.format_string(f"{name}: %d #", key).alias("line"))
             for i, (name, key, f) in enumerate((("way", "way", ways), ("rel", "rel", relations)))]
    return parts[0].unionByName(parts[1]).orderBy("part", "id").select("line")


def merged_ids(*frames: DataFrame) -> DataFrame:
    """Distinct ids of several one-column frames, as ``id``."""
    out = None
    for f in frames:
        f = f.toDF("id")
        out = f if out is None else out.unionByName(f)
    return out.distinct()
