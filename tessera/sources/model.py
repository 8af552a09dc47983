"""Schemas of map elements; one table holds all kinds, typed tables are its projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.tags import clean
from ..functions.units import to_map_unit

TAGS = "array<struct<k:string,v:string>>"
MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"
#: kind is n, w, r or b (bounds: lat, lon and lat2, lon2 are the corners).
ELEMENT = f"kind string, id bigint, version int, lat double, lon double, lat2 double, lon2 double, refs array<bigint>, members {MEMBERS}, tags {TAGS}, file_seq int, elem_seq bigint"
COLUMNS = ["kind", "id", "version", "lat", "lon", "lat2", "lon2", "refs", "members", "tags", "file_seq", "elem_seq"]


def invalid(lat: Column, lon: Column) -> Column:
    """Coordinates beyond the globe, at which a run stops."""
    return (F.abs(lat) > 90) | (F.abs(lon) > 180)


def nodes(elements: DataFrame) -> DataFrame:
    n = elements.where("kind = 'n' AND lat IS NOT NULL AND lon IS NOT NULL AND id IS NOT NULL")
    bad = invalid(F.col("lat"), F.col("lon"))
    lat = F.when(bad, F.raise_error(F.concat(F.lit("invalid coordinates of node "), F.col("id").cast("string"))).cast("double")).otherwise(F.col("lat"))
    return n.select("id", "version", lat.alias("lat"), "lon", to_map_unit(F.col("lat")).alias("mlat"), to_map_unit(F.col("lon")).alias("mlon"), clean(F.col("tags")).alias("tags"), "file_seq", "elem_seq")


def ways(elements: DataFrame) -> DataFrame:
    return elements.where("kind = 'w'").select("id", "version", "refs", clean(F.col("tags")).alias("tags"), "file_seq", "elem_seq")


def relations(elements: DataFrame) -> DataFrame:
    known = F.filter("members", lambda m: m["type"].isin("node", "way", "relation"))
    return elements.where("kind = 'r'").select("id", "version", known.alias("members"), clean(F.col("tags")).alias("tags"), "file_seq", "elem_seq")


def bounds(elements: DataFrame) -> DataFrame:
    """Boxes the input names; an invalid one raises."""
    edges = {"min_lat": "lat", "min_lon": "lon", "max_lat": "lat2", "max_lon": "lon2"}
    b = elements.where("kind = 'b'").select("file_seq", *[to_map_unit(F.col(c)).alias(e) for e, c in edges.items()])
    text = F.concat(F.lit("invalid bounds in the input: "), F.concat_ws(",", *edges))
    checked = F.when(boxes.valid(boxes.box()), F.col("min_lat")).otherwise(F.raise_error(text).cast("int"))
    return b.select("file_seq", checked.alias("min_lat"), "min_lon", "max_lat", "max_lon")


def way_refs(w: DataFrame) -> DataFrame:
    """(way, pos, node)."""
    return w.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "node")).withColumn("pos", F.col("pos").cast("long"))


def relation_members(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rel, way, pos, role), (rel, node) and edges (parent, child)."""
    m = r.select(F.col("id").alias("rel"), F.posexplode("members").alias("pos", "m")).select("rel", "pos", "m.*")
    return (
        m.where("type = 'way'").select("rel", F.col("ref").alias("way"), "pos", "role"),
        m.where("type = 'node'").select("rel", F.col("ref").alias("node")),
        m.where("type = 'relation'").select(F.col("rel").alias("parent"), F.col("ref").alias("child")),
    )
