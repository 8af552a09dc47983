"""Small text formats, read and written on the driver: tile lists, polygons, KML, problem ids, densities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import WORLD_LAT, WORLD_LON, to_map_unit
from .files import read_text

UNIT = 360.0 / (1 << 24)


@dataclass(frozen=True)
class Tile:
    map_id: int
    min_lat: int
    min_lon: int
    max_lat: int
    max_lon: int
    name: str | None = None

    def check(self) -> Tile:
        ok = self.min_lat <= self.max_lat and self.min_lon <= self.max_lon
        if not ok or abs(self.min_lat) > WORLD_LAT or abs(self.max_lat) > WORLD_LAT or abs(self.min_lon) > WORLD_LON or abs(self.max_lon) > WORLD_LON:
            raise ValueError(f"invalid box of tile {self.map_id:08d}")
        return self


_AREA = re.compile(r"^([0-9]{8}):\s*(\S+?)\s*,\s*(\S+)\s+to\s+(\S+?)\s*,\s*(\S+)")


def _number(text: str) -> int:
    """Decimal, or hexadecimal with 0x; leading zeros stay decimal."""
    return int(text, 16) if text.lower().lstrip("+-").startswith("0x") else int(text)


def parse_areas_list(text: str) -> list[Tile]:
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and (m := _AREA.match(line)):
            out.append(Tile(int(m[1]), *map(_number, m.groups()[1:])).check())
    return out


def areas_list(tiles: list[Tile]) -> str:
    """One line a tile, with a comment line that shows degrees."""
    out = ["# List of areas"]
    for t in tiles:
        out.append(f"{t.map_id:08d}: {t.min_lat},{t.min_lon} to {t.max_lat},{t.max_lon}")
        out.append("#       : %.6f,%.6f to %.6f,%.6f" % tuple(v * UNIT for v in (t.min_lat, t.min_lon, t.max_lat, t.max_lon)))
        out.append("")
    return "\n".join(out) + "\n"


def _units(degrees: float) -> int:
    return int(degrees / UNIT + (0.5 if degrees > 0 else -0.5))


def parse_areas_kml(text: str) -> list[Tile]:
    """Placemarks whose name is the map id; five corners, of which the first and third are opposite."""
    out = []
    for mark in (e for e in ElementTree.fromstring(text).iter() if e.tag.endswith("Placemark")):
        name = next(e.text for e in mark.iter() if e.tag.endswith("name"))
        corners = [tuple(map(float, p.split(",")[:2])) for p in next(e.text for e in mark.iter() if e.tag.endswith("coordinates")).split()]
        if len(corners) != 5:
            raise ValueError(f"tile {name} needs five corners, has {len(corners)}")
        (lon1, lat1), (lon2, lat2) = corners[0], corners[2]
        out.append(Tile(int(name), _units(min(lat1, lat2)), _units(min(lon1, lon2)), _units(max(lat1, lat2)), _units(max(lon1, lon2))).check())
    return out


def areas_kml(tiles: list[Tile]) -> str:
    kml = ElementTree.Element("kml", xmlns="http://www.opengis.net/kml/2.2")
    doc = ElementTree.SubElement(kml, "Document")
    for t in tiles:
        mark = ElementTree.SubElement(doc, "Placemark")
        ElementTree.SubElement(mark, "name").text = f"{t.map_id:08d}"
        ElementTree.SubElement(mark, "description").text = t.name or ""
        ring = ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(mark, "Polygon"), "outerBoundaryIs"), "LinearRing")
        corners = [(t.min_lon, t.min_lat), (t.min_lon, t.max_lat), (t.max_lon, t.max_lat), (t.max_lon, t.min_lat), (t.min_lon, t.min_lat)]
        ElementTree.SubElement(ring, "coordinates").text = "\n".join(f"{x * UNIT:.6f},{y * UNIT:.6f}" for x, y in corners)
    return "<?xml version='1.0' encoding='UTF-8'?>\n" + ElementTree.tostring(kml, encoding="unicode") + "\n"


def read_areas(path: str) -> list[Tile]:
    text = read_text(path)
    return parse_areas_kml(text) if ".kml" in path.rsplit("/", 1)[-1] else parse_areas_list(text)


def tiles_frame(spark: SparkSession, tiles: list[Tile]) -> DataFrame:
    """(tile, map_id, edges, name); the tile number is the place in the list."""
    rows = [(i, t.map_id, t.min_lat, t.min_lon, t.max_lat, t.max_lon, t.name) for i, t in enumerate(tiles)]
    return spark.createDataFrame(rows, "tile long, map_id long, min_lat long, min_lon long, max_lat long, max_lon long, name string")


def template_args(tiles: list[Tile], output: str = "pbf", first_id: int | None = None) -> str:
    """Map compiler arguments by tile; with ``first_id`` tiles are numbered from there, a multiple of 100 raised by one."""
    ending = {"xml": ".osm.gz", "o5m": ".o5m"}.get(output, ".osm.pbf")
    out = ["# Options for the tiles", ""]
    start = None if first_id is None else first_id + (first_id % 100 == 0)
    for i, t in enumerate(tiles):
        out += [f"mapname: {t.map_id if start is None else start + i:08d}", f"description: {t.name[:50]}" if t.name else "# description: OSM Map", f"input-file: {t.map_id:08d}{ending}", ""]
    return "\n".join(out)


# ---- polygons ----

@dataclass
class Ring:
    points: list[tuple[float, float]] = field(default_factory=list)  # (lon, lat), closed
    hole: bool = False


def parse_poly(text: str) -> tuple[str, list[Ring]]:
    """Name and rings of a polygon file; sections with ! are holes."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    name, rings, at = lines[0], [], 1
    while at < len(lines) and lines[at] != "END":
        ring = Ring(hole=lines[at].startswith("!"))
        at += 1
        while lines[at] != "END":
            lon, lat = lines[at].split()[:2]
            ring.points.append((float(lon), float(lat)))
            at += 1
        if ring.points and ring.points[0] != ring.points[-1]:
            ring.points.append(ring.points[0])
        rings.append(ring)
        at += 1
    if at >= len(lines):
        raise ValueError("the polygon file does not end with END")
    return name, rings


def poly(name: str, rings: list[Ring]) -> str:
    out, n, holes = [name], 0, 0
    for r in rings:
        n, holes = (n, holes + 1) if r.hole else (n + 1, holes)
        out += [f"!{holes}" if r.hole else f"{n}", *[f"  {x:.6f}  {y:.6f}" for x, y in r.points], "END"]
    return "\n".join([*out, "END"]) + "\n"


# ---- problem ids, densities, cities, sea ----

def parse_problem_ids(text: str) -> tuple[list[int], list[int]]:
    """(ways, relations) of ``way:<id>`` and ``rel:<id>`` lines; any other line makes the file invalid."""
    found: dict[str, list[int]] = {"way": [], "rel": []}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.split("#")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(way|rel)\s*:\s*(-?[0-9]+)", line)
        if not m:
            raise ValueError(f"line {n} is no problem id: {line}")
        found[m[1]].append(int(m[2]))
    return found["way"], found["rel"]


def read_density(spark: SparkSession, path: str) -> tuple[tuple[int, ...], DataFrame]:
    """(box, cells): the first two lines are boxes, of which bounds go first if there are any."""
    lines = spark.read.text(path)
    boxes = [r[0] for r in lines.limit(2).collect()]
    chosen = boxes[0] if boxes[1].startswith("no_bounds") else boxes[1]
    cut = F.split("value", ",")
    cells = lines.where(F.col("value").rlike("^[0-9]+,[0-9]+,[0-9]+$")).select(cut[0].cast("int").alias("x"), cut[1].cast("int").alias("y"), cut[2].cast("long").alias("n"))
    return tuple(int(x) for x in re.findall(r"-?[0-9]+", chosen)[:4]), cells


def density_lines(box: tuple[int, ...], cells: DataFrame, bounds: tuple[int, ...] | None = None) -> Iterator[str]:
    """The box of the nodes, the bounds the input names, then x-major cells, empty ones left out."""
    yield ",".join(map(str, box))
    yield ",".join(map(str, bounds)) if bounds else "no_bounds_in_input"
    for r in cell_lines(cells).toLocalIterator():
        yield r["line"]


def cell_lines(cells: DataFrame) -> DataFrame:
    return cells.where("n > 0").orderBy("x", "y").select(F.concat_ws(",", "x", "y", "n").alias("line"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """(id, country, name, lat, lon, population) of a GeoNames table; bad lines go, ``bad_cities`` tells them."""
    c = _city_lines(spark, path).where(_CITY).drop("value")
    return c.select("id", "country", "name", to_map_unit(F.col("y")).alias("lat"), to_map_unit(F.col("x")).alias("lon"), "population")


def bad_cities(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a GeoNames table that are no city."""
    return _city_lines(spark, path).where(~F.coalesce(F.expr(_CITY), F.lit(False))).select("value")


_CITY = "id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND population IS NOT NULL"


def _city_lines(spark: SparkSession, path: str) -> DataFrame:
    cut = F.split("value", "\t")
    return spark.read.text(path).select(
        "value",
        cut[0].try_cast("long").alias("id"), F.get(cut, F.lit(8)).alias("country"), F.get(cut, F.lit(2)).alias("name"),
        F.get(cut, F.lit(4)).try_cast("double").alias("y"), F.get(cut, F.lit(5)).try_cast("double").alias("x"), F.get(cut, F.lit(14)).try_cast("long").alias("population"),
    )


SEA_RASTER = 15


def sea_index(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, what): keys on the 2^15 raster; what is ``sea``, ``land`` or a file name."""
    m = r"^(-?[0-9]+)_(-?[0-9]+);(.+)$"
    return spark.read.text(path).where(F.col("value").rlike(m)).select(
        F.regexp_extract("value", m, 1).cast("int").alias("lat"), F.regexp_extract("value", m, 2).cast("int").alias("lon"), F.regexp_extract("value", m, 3).alias("what"),
    )


def sea_files(index: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Raster tiles inside a box that have a file."""
    lat0, lon0, lat1, lon1 = box
    size = 1 << SEA_RASTER
    inside = F.col("lat").between((lat0 >> SEA_RASTER) * size, lat1) & F.col("lon").between((lon0 >> SEA_RASTER) * size, lon1)
    return index.where(inside & ~F.col("what").isin("sea", "land"))
