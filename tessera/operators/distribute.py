"""Every element to all its tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assign, multitile, problems
from .lineage import stored


@dataclass
class Elements:
    """A map as tables: points (id, mlat, mlon), refs (way, pos, node), members, edges, wanted relations."""

    points: DataFrame
    refs: DataFrame
    way_members: DataFrame
    node_members: DataFrame
    edges: DataFrame
    wanted: DataFrame
    area_relations: DataFrame | None = None
    ring_members: DataFrame | None = None


@dataclass
class Tiled:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    problem_ways: DataFrame
    problem_relations: DataFrame


def _or_else(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Sets of ``first``; keys it does not have take their rows of ``second``."""
    return first.select(key, "word", "mask").unionByName(second.join(first.select(key), key, "left_anti").select(key, "word", "mask"))


def _each(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, word, mask) of the lists in a column."""
    return multitile.words(rows.select(key, F.explode(name).alias("tile")), key)


def distribute_plain(e: Elements, tiles: DataFrame, overlap: int = 2000) -> Tiled:
    """Without keep-complete: elements go where their nodes are."""
    nt = assign.node_tiles(e.points, tiles, overlap)
    wt = assign.way_tiles(e.refs, nt)
    rt = assign.relation_tiles(e.node_members, e.way_members, nt, wt)
    return Tiled(nt, wt, rt, wt.select("way").limit(0), rt.select("rel").limit(0))


def distribute_complete(
    e: Elements, tiles: DataFrame, areas: DataFrame | None = None, overlap: int = 0,
    user_ways: DataFrame | None = None, user_relations: DataFrame | None = None, uncrossable: DataFrame | None = None,
) -> Tiled:
    """With keep-complete: problem elements and all they consist of are whole in each of their tiles.

    ``areas`` are the working areas (tile column, plus ``real``: the tile or null for one
    outside all tiles); by default they are the tiles.
    """
    area = "tiles" if areas is None and not overlap else "areas"
    spots = assign.spots(e.points.select(F.col("id").alias("node"), "mlat", "mlon"), tiles, overlap)
    if area == "areas":
        spots = assign.spots(spots, areas if areas is not None else tiles, name=area)
    # The two joins with all nodes; from here on a way is one row, and sets of tiles are bits of 64.
    whole = stored(assign.whole_ways(e.refs, spots, area, e.ring_members is not None))
    members = stored(e.node_members.join(spots, "node").select("rel", "node", *dict.fromkeys(["tiles", area])))

    pw = whole.where("size(areas) > 1").select("way")
    if user_ways is not None:
        pw = pw.unionByName(user_ways.select("way")).distinct()
    held = e.way_members.join(whole.select("way", "areas"), "way")
    ra = stored(multitile.merged("rel", _each(held, "rel", "areas"), _each(members, "rel", area)).join(e.wanted.select("rel"), "rel", "left_semi"))
    lying = ra.groupBy("rel").agg(F.sum(F.bit_count("mask")).alias("n"), F.min("word").alias("word"), F.bit_or("mask").alias("mask"))
    pr = lying.where("n > 1").select("rel")
    if user_relations is not None:
        pr = pr.unionByName(user_relations.select("rel")).distinct()
    single = lying.where("n = 1").select("rel", "word", "mask")
    if areas is not None:
        real = multitile.spread(single, "rel").join(areas.select("tile", "real"), "tile")
        single = multitile.words(real.select("rel", F.col("real").alias("tile")), "rel")

    pairs = multitile.closure(e.edges)
    cl = stored(multitile.downward(pr, pairs))
    cl_ways = e.way_members.select("rel", "way").join(cl, "rel", "left_semi")
    cl_nodes = members.join(cl, "rel", "left_semi")

    test = whole.where("line IS NOT NULL")
    if uncrossable is not None:
        shut = uncrossable.select(F.col("tiles").alias("text"), F.lit(True).alias("shut"))
        text = F.array_join(F.array_sort("tiles"), ",")
        test = test.withColumn("text", text).join(shut, "text", "left").where("outside OR shut IS NULL")
    own = _each(whole, "way", "tiles")
    by_box = assign.box_tiles(whole.where("closed").select("way", "box.*"), tiles, "way")
    by_line = assign.crossings(assign.lines(test), tiles)
    shape = stored(multitile.merged("way", _each(whole.where("NOT closed"), "way", "tiles"), multitile.words(by_box, "way"), multitile.words(by_line, "way")))

    rt = multitile.merged("rel", cl_ways.join(shape, "way"), _each(cl_nodes, "rel", "tiles"))
    if e.ring_members is not None and e.area_relations is not None:
        rings = multitile.rings(e.ring_members.join(cl.join(e.area_relations, "rel", "left_semi"), "rel", "left_semi"))
        boxes = assign.box_tiles(multitile.ring_boxes(rings, whole.select("way", "box.*")), tiles, "rel")
        rt = multitile.merged("rel", rt.join(boxes, "rel", "left_anti"), multitile.words(boxes, "rel"))
    in_cl = pairs.join(cl.select(F.col("rel").alias("ancestor")), "ancestor", "left_semi")
    rt = stored(multitile.with_below(rt, in_cl))

    nw = pw.select("way").unionByName(cl_ways.select("way"))
    handed = cl_ways.join(whole.select("way"), "way", "left_semi").join(rt, "rel")
    wt1 = stored(multitile.merged("way", shape.join(nw, "way", "left_semi"), handed))
    through = whole.select("way", "nodes").join(wt1, "way").select(F.explode("nodes").alias("node"), "word", "mask")
    nodes = multitile.merged("node", _each(spots, "node", "tiles"), cl_nodes.select("rel", "node").join(rt, "rel"), through)
    ways = _or_else(wt1, own, "way")
    # What is settled otherwise does not have to be looked up in its members.
    settled = single.select("rel").unionByName(rt.select("rel"))
    rest = e.way_members.select("rel", "way").join(settled, "rel", "left_anti").join(ways, "way")
    plain = multitile.merged("rel", rest, _each(members.join(settled, "rel", "left_anti"), "rel", "tiles"))
    relations = _or_else(single, rt, "rel").unionByName(plain).where("mask IS NOT NULL")
    return Tiled(multitile.spread(nodes, "node"), multitile.spread(ways, "way"), multitile.spread(relations, "rel"), pw, pr)


def per_tile(t: Tiled) -> DataFrame:
    """(tile, kind, n)."""
    kinds = [f.select("tile", F.lit(k).alias("kind")) for k, f in (("node", t.nodes), ("way", t.ways), ("relation", t.relations))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("tile", "kind").agg(F.count("*").alias("n"))
