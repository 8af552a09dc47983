"""A whole run: map files to tiles, in the stages density, tile calculation, problem list, multi-tile and distribution."""

from __future__ import annotations

import os
import time
import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, tags, units
from ..operators import assign, density, distribute, polygons, problems, solver
from ..operators.lineage import cut
from ..sinks.tiles import placed, write_tiles
from ..sources import files, model, osm, texts
from ..sources.texts import Ring, Tile
from .options import Options

#: Name, first map id and rings in map units.
Polygons = list[tuple[str, int, list[Ring]]]
#: A density file of this name in the current folder is used; each run writes its own beside the tiles.
DENSITIES, DENSITIES_OUT = "densities.txt", "densities-out.txt"


@dataclass
class Run:
    options: Options
    tiles: list[Tile] = field(default_factory=list)
    tiled: distribute.Tiled | None = None
    written: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def _box(row: Row) -> tuple[int, int, int, int] | None:
    return None if row[0] is None else tuple(int(row[e]) for e in boxes.EDGES)


def _bounds(elements: DataFrame) -> tuple[int, int, int, int] | None:
    """The box of all bounds in the input."""
    return _box(boxes.union_box(model.bounds(elements)).first())


def _aligned(box: tuple[int, int, int, int], shift: int) -> tuple[int, int, int, int]:
    size, limit = 1 << shift, units.GRID_LAT
    lat0, lon0, lat1, lon1 = max(box[0], -limit), box[1], min(box[2], limit), box[3]
    down, up = (lambda v: v // size * size), (lambda v: -(-v // size) * size)
    return down(lat0), max(down(lon0), -units.WORLD_LON), max(up(lat1), down(lat0) + size), min(max(up(lon1), down(lon0) + size), units.WORLD_LON)


def _rings_in_units(rings: list[Ring]) -> list[Ring]:
    return [Ring([(x / texts.UNIT, y / texts.UNIT) for x, y in r.points], r.hole) for r in rings]


def polygon_descriptions(spark: SparkSession, path: str, resolution: int) -> list[tuple[str, int, list[Ring]]]:
    """(name, map id, rings) of the ways tagged ``name`` and integer ``mapid``; corners are rounded to the grid."""
    e = osm.read_osm(spark, path)
    shift = 24 - resolution
    n = model.nodes(e).select(F.col("id").alias("node"), units.round_nearest(F.col("mlat"), shift).alias("y"), units.round_nearest(F.col("mlon"), shift).alias("x"))
    w = model.ways(e).select("id", tags.first(F.col("tags"), "name").alias("name"), tags.first(F.col("tags"), "mapid").try_cast("int").alias("mapid"), "refs").where("name IS NOT NULL AND mapid IS NOT NULL")
    refs = w.select(F.col("id").alias("way"), "name", "mapid", F.posexplode("refs").alias("pos", "node")).join(n, "node")
    rows = refs.groupBy("way", "name", "mapid").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).orderBy("mapid").collect()
    return [(r["name"], r["mapid"], [Ring([(float(p["x"]), float(p["y"])) for p in r["p"]])]) for r in rows]


def calculate_tiles(spark: SparkSession, o: Options, elements: DataFrame, points: DataFrame) -> tuple[list[Tile], Polygons]:
    """Tiles, and the polygons they were calculated for. With num-tiles polygons do not bound them."""
    shift = 24 - o.resolution
    given = o.density_file or (os.path.abspath(DENSITIES) if files.exists(DENSITIES) else None)
    if given:
        box, cells = texts.read_density(spark, given)
    else:
        nodes, bounds = _box(density.data_box(points).first()), None if o.ignore_osm_bounds else _bounds(elements)
        if nodes is None:
            return [], []
        box = bounds or nodes
    polys: Polygons = []
    if o.polygon_file:
        name, rings = texts.parse_poly(files.read_text(o.polygon_file))
        polys = [(name, o.mapid, _rings_in_units(rings))]
    elif o.polygon_desc_file:
        polys = polygon_descriptions(spark, o.polygon_desc_file, o.resolution)
    box = _aligned(box, shift)
    if not given:
        cells = cut(density.density(points, shift, box))
        files.write_lines(f"{o.output_dir}/{DENSITIES_OUT}", texts.density_lines(nodes, cells, bounds))
    if any(polygons.too_complex(r, shift) for _, _, r in polys):
        warnings.warn("a bounding polygon is complex: the split may not follow it closely", stacklevel=2)
    if o.precomp_sea:
        index = texts.sea_index(spark, f"{o.precomp_sea}/index.txt.gz")
        names = [r["what"] for r in texts.sea_files(index, box).collect()]  # raster files of one map: a few thousand at most
        if names:
            sea = model.nodes(osm.read_osm(spark, *[f"{o.precomp_sea}/{n}" for n in names], kinds="n"))
            cells = density.merge_sea(cells, density.density(sea, shift, box))
    width, height = (box[3] - box[1]) >> shift, (box[2] - box[0]) >> shift
    grid = solver.Grid.from_cells(cells, shift, width, height, box[0] >> shift)

    def solved(g: solver.Grid) -> list[solver.Rect]:
        if g.inside is not None:
            return solver.split_polygon(g, o.max_nodes, o.search_limit)
        if o.num_tiles:
            return solver.split_to(g, o.num_tiles, o.search_limit, not o.no_trim)
        return solver.split(g, o.max_nodes, o.search_limit, not o.no_trim)

    of: list[list[Ring]] = []
    if polys and not o.num_tiles:
        # Cells are shared out by the set of polygons that cover them; each share is split on its own.
        layers = np.stack([polygons.rasterise(r, box[0], box[1], width, height, shift) for _, _, r in polys])
        code = np.zeros(layers.shape[1:], dtype=object)
        for i, layer in enumerate(layers):
            code[layer] += 1 << i
        rects = []
        for c in sorted(set(code.ravel()) - {0}):
            found = solved(solver.Grid(grid.counts, shift, grid.row0, code == c))
            rects += found
            of += [polys[c.bit_length() - 1][2] if c & (c - 1) == 0 else []] * len(found)
    else:
        rects = solved(grid)
    size = 1 << shift
    tiles = [Tile(o.mapid + i, box[0] + r.y0 * size, box[1] + r.x0 * size, box[0] + r.y1 * size, box[1] + r.x1 * size) for i, r in enumerate(rects)]
    # A tile of one polygon ends at its border where that leaves a rectangle.
    tiles = [polygons.cut_to(r, t) if r else t for t, r in zip(tiles, of)] if of else tiles
    if tiles and tiles[-1].map_id > 99_999_999:
        raise ValueError("the map ids of the tiles go beyond 99999999")
    return tiles, polys


def _named(spark: SparkSession, o: Options, tiles: list[Tile]) -> list[Tile]:
    names: dict[int, str | None] = {}
    if o.geonames_file and tiles:
        named = assign.named_tiles(texts.read_cities(spark, o.geonames_file), texts.tiles_frame(spark, tiles).drop("name"))
        names = {r["tile"]: r["name"] for r in named.collect()}
        bad = texts.bad_cities(spark, o.geonames_file)
        if some := bad.limit(3).collect():
            warnings.warn(f"{bad.count()} lines of {o.geonames_file} are no cities, such as: {'; '.join(r['value'][:80] for r in some)}", stacklevel=2)
    return [replace(t, name=names.get(i) or t.name or o.description) for i, t in enumerate(tiles)]


def _outline(tiles: list[Tile]) -> str:
    return texts.poly("area", [Ring([(x * texts.UNIT, y * texts.UNIT) for x, y in r.points], r.hole) for r in polygons.outline(tiles)])


def _write_lists(o: Options, tiles: list[Tile], polys: Polygons) -> None:
    """Lists of all tiles; for each polygon own ones of the tiles that meet it, named and numbered by it."""
    out = {"areas.list": texts.areas_list(tiles), "areas.poly": _outline(tiles), "template.args": texts.template_args(tiles, o.output)}
    if o.write_kml:
        out[o.write_kml] = texts.areas_kml(tiles)
    for polygon, first_id, rings in polys:
        own = [t for t in tiles if polygons.meets(rings, t)]
        out |= {f"{polygon}-areas.poly": _outline(own), f"{polygon}-template.args": texts.template_args(own, o.output, first_id)}
        if o.write_kml:
            folder, _, kml = o.write_kml.rpartition("/")
            out[f"{folder}/{polygon}-{kml}" if folder else f"{polygon}-{kml}"] = texts.areas_kml(own)
    for name, text in out.items():
        files.write_bytes(f"{o.output_dir}/{name}", text.encode("utf-8"))




def elements_of(e: DataFrame, o: Options) -> distribute.Elements:
    n, w, r = model.nodes(e), model.ways(e), model.relations(e)
    ways, nodes, edges = model.relation_members(r)
    refs = model.way_refs(w)
    wanted = r.where(tags.wanted_relation(F.col("tags"), o.boundaries, o.wanted_admin_level)).select(F.col("id").alias("rel"))
    area = r.where(tags.is_area_relation(F.col("tags"))).select(F.col("id").alias("rel"))
    ends = refs.groupBy("way").agg(F.min_by("node", "pos").alias("first"), F.max_by("node", "pos").alias("last"))
    return distribute.Elements(n.select("id", "mlat", "mlon"), refs, ways.select("rel", "way"), nodes, edges, wanted, area, ways.join(ends, "way"))


def run(spark: SparkSession, o: Options) -> Run:
    """Input is read once into a checkpoint; the reference's repeated passes are joins on it."""
    out = Run(o.check())
    at = time.time()

    def lap(stage: str) -> None:
        nonlocal at
        out.seconds[stage], at = time.time() - at, time.time()

    elements = cut(osm.read_osm(spark, *o.files))
    points = model.nodes(elements).select("id", "mlat", "mlon")
    lap("read")
    if o.split_file:
        tiles, polys = texts.read_areas(o.split_file), []
    else:
        tiles, polys = calculate_tiles(spark, o, elements, points)
    out.tiles = tiles = _named(spark, o, tiles)
    _write_lists(o, tiles, polys)
    lap("tile calculation")
    if o.stop_after == "split" or not tiles:
        return out

    frame = cut(texts.tiles_frame(spark, tiles))
    e = elements_of(elements, o)
    if o.keep_complete:
        areas = [(a, own[0]) for a, own in polygons.distinct_areas(tiles)] + [(a, None) for a in polygons.pseudo_areas(tiles)]
        rows = [(i, a.min_lat, a.min_lon, a.max_lat, a.max_lon, real) for i, (a, real) in enumerate(areas)]
        working = spark.createDataFrame(rows, "tile long, min_lat long, min_lon long, max_lat long, max_lon long, real long")
        closed = [(",".join(map(str, s)),) for s in polygons.rectangle_unions(tiles)]
        uncrossable = spark.createDataFrame(closed, "tiles string") if closed else None
        user_ways = user_relations = None
        if o.problem_file:
            w, r = texts.parse_problem_ids(files.read_text(o.problem_file))
            user_ways, user_relations = spark.createDataFrame([(x,) for x in w], "way long"), spark.createDataFrame([(x,) for x in r], "rel long")
        out.tiled = distribute.distribute_complete(e, frame, working, o.grown_by, user_ways, user_relations, uncrossable)
        if o.problem_report:
            lines = problems.report(out.tiled.problem_ways, out.tiled.problem_relations).toLocalIterator()
            files.write_lines(f"{o.output_dir}/{o.problem_report}", (r["line"] for r in lines))
        lap("problem list and multi-tile")
        if o.stop_after != "dist":
            return out
    else:
        out.tiled = distribute.distribute_plain(e, frame, o.grown_by)
    all_of = reduce(DataFrame.unionByName, [elements.where(F.col("kind") == k) for k in "nwr"]).withColumn("tags", tags.clean(F.col("tags")))
    located = placed(all_of, out.tiled.nodes, out.tiled.ways, out.tiled.relations)
    if o.output == "parquet":
        located.repartition("tile").sortWithinPartitions("kind", "elem_seq").write.mode("overwrite").partitionBy("tile").parquet(f"{o.output_dir}/tiles")
    else:
        out.written = cut(write_tiles(located, frame, o.output_dir, o.output, o.handle_element_version))
    lap("distribution")
    return out
