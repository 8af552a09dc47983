"""Queries over the derived graph, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, geometry, tags, units
from ..operators import assign, density, distribute, multitile, polygons, problems, solver
from ..operators.lineage import stored
from ..shipping import ship
from ..streaming import events
from ..sources import model, texts
from ..sources.derived import TILE_LAT, TILE_LON, TILES, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHIFT = 11
MAP_ID = 63240001
GRID = (0, 0, TILES * TILE_LAT, TILES * TILE_LON)


def query(f: Callable[[Graph], DataFrame]):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(Graph(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def _long(df: DataFrame) -> DataFrame:
    """Integers as longs, so that engines agree on types."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# ---- projections, units, boxes ----

@query
def nodes_projected(g: Graph) -> DataFrame:
    return g.points


@query
def map_units(g: Graph) -> DataFrame:
    deg = (F.pmod("event_id", F.lit(360001)) - 180000) / 1000.0
    return _long(g.table("events").select(F.col("event_id").alias("id"), units.to_map_unit(deg).alias("unit")))


@query
def degrees_rounded(g: Graph) -> DataFrame:
    return g.points.select("id", F.round(units.to_degrees(F.col("mlat")), 6).alias("lat"), F.round(units.to_degrees(F.col("mlon")), 6).alias("lon"))


@query
def round_down_up_nearest(g: Graph) -> DataFrame:
    v = F.col("mlat") - 80000
    return g.points.select("id", units.round_down(v, 11).alias("down"), units.round_up(v, 11).alias("up"), units.round_nearest(v, 2).alias("near"))


def _small_tiles(g: Graph) -> DataFrame:
    """Tiles moved off the grid, some of them overlapping, some empty."""
    t = F.col("tile")
    return g.tiles.select("tile", (F.col("min_lat") - t * 37).alias("min_lat"), (F.col("min_lon") + t * 11).alias("min_lon"),
                          (F.col("max_lat") - t % 5 * 20480).alias("max_lat"), (F.col("max_lon") + t % 3 * 5000).alias("max_lon"))


@query
def area_rounded(g: Graph) -> DataFrame:
    return _long(_small_tiles(g).select("tile", *boxes.select_box(units.round_box(boxes.at_least_one(boxes.box()), 13))))


def _pairs(g: Graph) -> DataFrame:
    """Each test box with itself and the 63 that follow it, found by number."""
    a = _small_tiles(g).withColumnsRenamed({"tile": "a"}).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(TILES * TILES - 1))))
    b = _small_tiles(g).withColumnsRenamed({"tile": "b", **{e: f"o_{e}" for e in boxes.EDGES}})
    return a.withColumn("b", (F.col("a") + F.col("b")) % (TILES * TILES)).join(b, "b")


@query
def box_relations(g: Graph) -> DataFrame:
    a, b = boxes.box(), boxes.box("o_")
    return _pairs(g).select("a", "b", boxes.contains_box(a, b).alias("a_contains_b"), boxes.touches(a, b).alias("touching"), boxes.overlaps(a, b).alias("overlapping"))


@query
def box_intersection(g: Graph) -> DataFrame:
    common = _pairs(g).select("a", "b", *boxes.select_box(boxes.intersection(boxes.box(), boxes.box("o_")), "i_"))
    return common.where("i_min_lat <= i_max_lat AND i_min_lon <= i_max_lon").select("a", "b", *[F.col(f"i_{e}").alias(e) for e in boxes.EDGES])


@query
def box_verify(g: Graph) -> DataFrame:
    return _small_tiles(g).select("tile", boxes.valid(boxes.box()).alias("valid"))


@query
def bounds_union(g: Graph) -> DataFrame:
    t = _small_tiles(g).where(boxes.valid(boxes.box())).withColumn("file", F.col("tile") % 4)
    return boxes.union_box(t, "file")


@query
def area_text(g: Graph) -> DataFrame:
    hexes = [F.concat(F.lit("0x"), F.lower(F.hex(F.col(e)))) for e in boxes.EDGES]
    return g.tiles.select("tile", F.concat_ws(",", *hexes).alias("hexes"), F.format_number(F.col("max_lon") * 10, 0).alias("thousands"))


@query
def node_validity(g: Graph) -> DataFrame:
    deg = F.pmod("event_id", F.lit(400)) - 200
    return _long(g.table("events").where(model.invalid(F.lit(0), deg)).select(F.col("event_id").alias("id"), deg.cast("long").alias("lon")))


@query
def parsed_doubles(g: Graph) -> DataFrame:
    text = F.concat(F.col("c_custkey").cast("string"), F.lit("."), (F.col("c_custkey") * 7919 % 1000003).cast("string"))
    return g.table("customer").select(F.col("c_custkey").alias("id"), text.cast("double").alias("value"))


@query
def sea_raster(g: Graph) -> DataFrame:
    v = F.col("mlon") - 100000
    return g.points.select("id", units.round_down(v, 15).alias("start"), units.round_up(v, 15).alias("stop"))


@query
def aspect_ratio(g: Graph) -> DataFrame:
    """Tile width to height as the search takes it: at the wider of both parallels, or at the equator within."""
    size = 1 << SHIFT
    grid = solver.Grid(np.zeros((GRID[3] >> SHIFT, GRID[2] >> SHIFT), dtype=np.int64), SHIFT)
    rows = [(r["tile"], float(grid.ratio(solver.Rect(*(r[e] // size for e in ("min_lon", "min_lat", "max_lon", "max_lat")))))) for r in g.tiles.collect()]
    return g.spark.createDataFrame(rows, "tile long, ratio double").select("tile", F.round("ratio", 6).alias("ratio"))


# ---- tags ----

@query
def tags_clean(g: Graph) -> DataFrame:
    t = tags.clean(F.col("tags"))
    return _long(g.ways.select("id", F.size(t).alias("n_tags"), F.array_join(F.transform(t, lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("text")))


@query
def tag_first(g: Graph) -> DataFrame:
    return g.ways.select("id", tags.first(F.col("tags"), "status").alias("value"), tags.first(F.col("tags"), "absent").isNull().alias("absent"))


@query
def relation_filter(g: Graph) -> DataFrame:
    t = F.col("tags")
    return g.relations.select(F.col("id").alias("rel"), tags.wanted_relation(t).alias("used"), tags.wanted_relation(t, ("administrative",), 9).alias("administrative"), tags.is_area_relation(t).alias("area"))


@query
def relation_names(g: Graph) -> DataFrame:
    return g.relations.select(F.col("id").alias("rel"), tags.display_name(F.col("tags")).alias("name"))


@query
def xml_escaped(g: Graph) -> DataFrame:
    """Over whole texts of the text table, which hold all kinds of characters."""
    return g.table("documents").select("doc_id", tags.escaped(F.col("text")).alias("escaped"))


@query
def version_policy(g: Graph) -> DataFrame:
    v = F.col("version")
    return _long(g.ways.select("id", *[tags.written_version(v, p).alias(p) for p in ("remove", "fake", "keep")]))


# ---- density ----

def _cells(g: Graph) -> DataFrame:
    return density.density(g.points, SHIFT, GRID)


@query
def density_cells(g: Graph) -> DataFrame:
    return _long(_cells(g))


@query
def density_total_max(g: Graph) -> DataFrame:
    return _long(_cells(g).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("cells")))


@query
def density_subset(g: Graph) -> DataFrame:
    return _long(density.subset(_cells(g), 10, 5, 90, 60))


@query
def density_columns(g: Graph) -> DataFrame:
    return _long(density.sums(_cells(g), "x"))


@query
def density_rows(g: Graph) -> DataFrame:
    return _long(density.sums(_cells(g), "y"))


@query
def density_cumulative(g: Graph) -> DataFrame:
    return _long(density.cumulative(_cells(g)))


@query
def density_gaps(g: Graph) -> DataFrame:
    """Between the columns that hold as many nodes as the average column, or more."""
    columns = density.sums(_cells(g), "x")
    average = columns.agg(F.avg("n").alias("average")).first()["average"]
    return _long(density.gaps(columns.where(F.col("n") >= F.lit(average))))


@query
def density_dump(g: Graph) -> DataFrame:
    return texts.cell_lines(_cells(g))


@query
def data_bbox(g: Graph) -> DataFrame:
    return density.data_box(g.points)


@query
def sea_merge(g: Graph) -> DataFrame:
    sea = g.table("events").groupBy((F.col("user_id") % 160).cast("int").alias("x"), (F.col("event_id") % 80).cast("int").alias("y")).agg(F.count("*").alias("n"))
    return _long(density.merge_sea(_cells(g), sea))


@query
def polygon_shares(g: Graph) -> DataFrame:
    """Three overlapping boxes in cells."""
    b = g.spark.range(3).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (F.col("id") * 30).alias("x0"), (F.col("id") * 10).alias("y0"), (F.col("id") * 30 + 70).alias("x1"), (F.col("id") * 10 + 50).alias("y1"))
    return _long(density.shares(_cells(g), b))


# ---- tiles of nodes, ways and relations ----

@query
def node_tiles(g: Graph) -> DataFrame:
    return assign.node_tiles(g.points, g.tiles)


@query
def node_tiles_overlap(g: Graph) -> DataFrame:
    return assign.node_tiles(g.points, g.tiles, 2000)


@query
def tile_node_counts(g: Graph) -> DataFrame:
    return node_tiles(g).groupBy("tile").agg(F.count("*").alias("n"))


@query
def way_tiles(g: Graph) -> DataFrame:
    return assign.way_tiles(g.refs, node_tiles(g))


@query
def way_tile_sets(g: Graph) -> DataFrame:
    return assign.tile_sets(way_tiles(g), "way")


@query
def tile_set_dictionary(g: Graph) -> DataFrame:
    return _long(assign.set_dictionary(way_tile_sets(g)))


@query
def way_bbox(g: Graph) -> DataFrame:
    return assign.way_boxes(assign.located(g.refs, g.points))


@query
def way_closed(g: Graph) -> DataFrame:
    per = g.ring_refs.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda r: r["node"]).alias("refs"))
    return per.select("way", geometry.is_closed(F.col("refs")).alias("closed"))


@query
def way_ends(g: Graph) -> DataFrame:
    ends = g.ring_refs.groupBy("way").agg(F.min_by("node", "pos").alias("first"), F.max_by("node", "pos").alias("last"), F.count("*").alias("n"))
    return ends.where("n >= 2").select("way", "first", "last")


@query
def ring_orientation(g: Graph) -> DataFrame:
    placed = assign.located(g.ring_refs, g.points)
    ring = placed.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mlat", "mlon"))), lambda r: F.struct(r["mlon"].alias("x"), r["mlat"].alias("y"))).alias("ring"))
    return ring.where("size(ring) > 3 AND ring[0] = element_at(ring, -1)").select("way", geometry.clockwise(F.col("ring")).alias("clockwise"))


@query
def way_segments(g: Graph) -> DataFrame:
    return assign.segments(assign.located(g.refs, g.points))


@query
def way_crossed_tiles(g: Graph) -> DataFrame:
    return assign.crossed_tiles(way_segments(g), g.tiles)


@query
def way_tiles_exact(g: Graph) -> DataFrame:
    return assign.open_way_tiles(assign.located(g.refs, g.points), node_tiles(g), g.tiles)


@query
def box_tiles(g: Graph) -> DataFrame:
    return assign.box_tiles(way_bbox(g), g.tiles, "way")


@query
def closed_way_tiles(g: Graph) -> DataFrame:
    return assign.box_tiles(assign.closed_boxes(g.ring_refs, g.points), g.tiles, "way")


@query
def relation_tiles(g: Graph) -> DataFrame:
    nt = node_tiles(g)
    return assign.relation_tiles(g.node_members, g.way_members, nt, assign.way_tiles(g.refs, nt))


@query
def overlapping_tiles(g: Graph) -> DataFrame:
    return assign.touching_pairs(_small_tiles(g).where("min_lat < max_lat"))


@query
def touching_tiles(g: Graph) -> DataFrame:
    return assign.touching_pairs(g.tiles, strict=False)


@query
def distinct_area_map(g: Graph) -> DataFrame:
    """Tiles that grow over their neighbours, cut to disjoint areas: size of the land by the set of tiles that cover it."""
    t = F.col("tile")
    grown = g.tiles.select("tile", (F.col("min_lat") - t % 3 * 500).alias("min_lat"), "min_lon", "max_lat", (F.col("max_lon") + t % 2 * 700).alias("max_lon"))
    tiles = [texts.Tile(r["tile"], *(r[e] for e in boxes.EDGES)) for r in grown.orderBy("tile").collect()]
    rows = [(",".join(str(tiles[i].map_id) for i in own), (a.max_lat - a.min_lat) * (a.max_lon - a.min_lon)) for a, own in polygons.distinct_areas(tiles)]
    return g.spark.createDataFrame(rows, "tiles string, size long").groupBy("tiles").agg(F.sum("size").alias("size"))


# ---- cities, names, lists ----

@query
def city_in_tile(g: Graph) -> DataFrame:
    return assign.cities_in_tiles(g.cities, g.tiles).select("tile", "id")


@query
def cities_by_latitude(g: Graph) -> DataFrame:
    return g.cities.orderBy("lat", "id").select("id", "country", "name", "lat", "population")


@query
def tile_names(g: Graph) -> DataFrame:
    return assign.named_tiles(g.cities, g.tiles)


def _numbered(g: Graph) -> DataFrame:
    """Tiles with nodes, numbered from the first map id."""
    from pyspark.sql import Window as W

    used = g.tiles.join(node_tiles(g).select("tile").distinct(), "tile", "left_semi")
    return used.withColumn("map_id", F.row_number().over(W.orderBy("tile")) - 1 + MAP_ID)


@query
def map_ids(g: Graph) -> DataFrame:
    return _long(_numbered(g).select("tile", "map_id"))


def _tile_list(g: Graph) -> list[texts.Tile]:
    """The tiles as a run lists them, on the driver."""
    named = _numbered(g).join(assign.named_tiles(g.cities, g.tiles), "tile").orderBy("map_id")
    return [texts.Tile(r["map_id"], *(r[e] for e in boxes.EDGES), r["name"]) for r in named.collect()]


@query
def areas_list_rows(g: Graph) -> DataFrame:
    lines = [x for x in texts.areas_list(_tile_list(g)).splitlines() if x and not x.startswith("#")]
    return g.spark.createDataFrame([(x,) for x in lines], "line string")


@query
def areas_list_parsed(g: Graph) -> DataFrame:
    """The file's text, comments and all, read back."""
    return texts.tiles_frame(g.spark, texts.parse_areas_list(texts.areas_list(_tile_list(g)))).select("map_id", *boxes.EDGES)


@query
def template_rows(g: Graph) -> DataFrame:
    lines = texts.template_args(_tile_list(g)).splitlines()
    starts = [i for i, x in enumerate(lines) if x.startswith("mapname")]
    return g.spark.createDataFrame([tuple(lines[i : i + 3]) for i in starts], "mapname string, description string, input_file string")


# ---- problems ----

@query
def problem_ways(g: Graph) -> DataFrame:
    return problems.problem_ways(way_tiles(g))


def _wanted(g: Graph) -> DataFrame:
    return g.relations.where(tags.wanted_relation(F.col("tags"))).select(F.col("id").alias("rel"))


@query
def problem_relations(g: Graph) -> DataFrame:
    return problems.problem_relations(problems.relation_areas(_wanted(g), relation_tiles(g)))


@query
def single_area_relations(g: Graph) -> DataFrame:
    return problems.single_area_relations(problems.relation_areas(_wanted(g), relation_tiles(g)))


@query
def problem_ids_union(g: Graph) -> DataFrame:
    user = g.ways.where("id % 50 = 0").select("id")
    return problems.merged_ids(problem_ways(g), user)


@query
def problem_report(g: Graph) -> DataFrame:
    return problems.report(problem_ways(g), problem_relations(g))


@query
def set_except(g: Graph) -> DataFrame:
    """Ways whose set of tiles loses its lowest tile."""
    sets = way_tiles(g).groupBy("way").agg(F.array_sort(F.collect_set("tile")).alias("t"))
    rest = F.array_except("t", F.array(F.array_min("t")))
    both = F.array_sort(F.array_union("t", F.array(F.lit(99).cast("long"))))
    return _long(sets.select("way", F.array_join(rest, ",").alias("rest"), F.array_join(both, ",").alias("more"), F.size("t").alias("n")))


@query
def needed_nodes_semi(g: Graph) -> DataFrame:
    return g.refs.join(problem_ways(g), "way", "left_semi").select("node").distinct()


@query
def missing_nodes_anti(g: Graph) -> DataFrame:
    """Ways without any node."""
    return g.ways.select(F.col("id").alias("way")).join(g.refs, "way", "left_anti")


@query
def merge_lookup(g: Graph) -> DataFrame:
    """Lookup in order on both sides: a sort-merge join by hint."""
    return g.points.join(node_tiles(g).hint("merge").withColumnRenamed("node", "id"), "id").select("id", "tile", "mlat")


# ---- relations ----

@query
def relation_closure(g: Graph) -> DataFrame:
    return multitile.closure(g.edges).select("ancestor", "descendant")


@query
def relation_loops(g: Graph) -> DataFrame:
    return multitile.loops(multitile.closure(g.edges))


@query
def relation_parents(g: Graph) -> DataFrame:
    """Of the problem relations and all that hold them."""
    seeds = problem_relations(g).select("rel")
    return multitile.upward(seeds, multitile.closure(g.edges))


@query
def parent_tiles(g: Graph) -> DataFrame:
    """Nations get the tiles of their customers."""
    pairs = multitile.closure(g.parent_edges)
    return multitile.with_descendants(relation_tiles(g), pairs)


@query
def member_propagation_ways(g: Graph) -> DataFrame:
    return multitile.to_ways(relation_tiles(g), g.way_members, way_tiles(g).select("way").distinct())


@query
def member_propagation_nodes(g: Graph) -> DataFrame:
    return multitile.to_nodes(relation_tiles(g), g.node_members, way_tiles(g), g.refs, g.points.select(F.col("id").alias("node")))


@query
def relation_incomplete(g: Graph) -> DataFrame:
    return multitile.incomplete(g.way_members, g.node_members, g.refs.select("way").distinct(), g.points.select(F.col("id").alias("node")))


@query
def relation_boxes(g: Graph) -> DataFrame:
    """The box of all ways of area relations: what their rings are at most."""
    area = g.relations.where(tags.is_area_relation(F.col("tags"))).select(F.col("id").alias("rel"))
    placed = g.way_members.join(area, "rel", "left_semi").join(way_bbox(g), "way")
    return boxes.union_box(placed, "rel")


@query
def relation_rings(g: Graph) -> DataFrame:
    """Chains of the ways of area relations, greedily joined at their ends."""
    area = g.relations.where(tags.is_area_relation(F.col("tags"))).select(F.col("id").alias("rel"))
    members = g.way_members.join(area, "rel", "left_semi").join(way_ends(g), "way").select("rel", F.col("way").alias("pos"), "way", F.lit("outer").alias("role"), "first", "last")
    return multitile.rings(members)


def _elements(g: Graph) -> distribute.Elements:
    """The derived nodes are an aggregation; it is done once."""
    g.nodes = stored(g.nodes)
    return distribute.Elements(g.points, g.refs, g.way_members, g.node_members, g.edges, _wanted(g))


@query
def distribution_nodes(g: Graph) -> DataFrame:
    return distribute.distribute_complete(_elements(g), g.tiles).nodes


@query
def distribution_ways(g: Graph) -> DataFrame:
    return distribute.distribute_complete(_elements(g), g.tiles).ways


@query
def distribution_relations(g: Graph) -> DataFrame:
    return distribute.distribute_complete(_elements(g), g.tiles).relations


@query
def distribution_plain(g: Graph) -> DataFrame:
    return distribute.per_tile(distribute.distribute_plain(_elements(g), g.tiles))


@query
def solver_tiles(g: Graph) -> DataFrame:
    """Tiles of the search over the density grid, with their node counts; the search is no SQL."""
    grid = solver.Grid.from_cells(_cells(g), SHIFT, GRID[3] >> SHIFT, GRID[2] >> SHIFT)
    budget = max(50, grid.count(grid.whole()) // 40)
    size = 1 << SHIFT
    rows = [(i, r.y0 * size, r.x0 * size, r.y1 * size, r.x1 * size, grid.count(r), float(grid.shape(r))) for i, r in enumerate(solver.split(grid, budget))]
    return g.spark.createDataFrame(rows, "tile long, min_lat long, min_lon long, max_lat long, max_lon long, n long, ratio double")


@query
def event_windows(g: Graph) -> DataFrame:
    return events.windowed_counts(g.table("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "cents")
