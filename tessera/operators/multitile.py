"""Complete objects: closure of relations and propagation of tiles to members."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored

MAX_DEPTH = 15


def closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ancestor, descendant, depth): pairs joined by a path of at most ``max_depth`` edges, with the shortest.

    Paths are doubled, so four joins reach depth 15; pairs are made distinct in
    each round, which also ends cycles. A shortest path that is longer than ``reach`` begins
    with one of exactly that length, so only the newest pairs are carried on.
    """
    pairs = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct().withColumn("depth", F.lit(1))
    reach = 1
    while reach < max_depth:
        left = pairs.where(F.col("depth") == reach).select("ancestor", F.col("descendant").alias("mid"))
        right = pairs.select(F.col("ancestor").alias("mid"), "descendant", (F.col("depth") + reach).alias("depth"))
        longer = left.join(right.where(F.col("depth") <= max_depth), "mid").select("ancestor", "descendant", "depth")
        # Each round uses the pairs three times: without a cut the plan would triple.
        pairs = stored(pairs.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        reach *= 2
    return pairs


def downward(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rel): the seeds and all relations below them."""
    below = pairs.join(seeds.select(F.col("rel").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("rel"))
    return seeds.select("rel").unionByName(below).distinct()


def upward(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rel): the seeds and all relations above them."""
    return downward(seeds, pairs.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant")))


def loops(pairs: DataFrame) -> DataFrame:
    """(rel) that are their own descendants."""
    return pairs.where("ancestor = descendant").select(F.col("ancestor").alias("rel")).distinct()


def words(pairs: DataFrame, key: str) -> DataFrame:
    """(key, word, mask): each tile of (key, tile) as a bit of 64; tile = 64 * word + bit, for any number."""
    return pairs.select(key, F.shiftright("tile", 6).cast("long").alias("word"), F.expr("shiftleft(1L, cast(tile & 63 AS int))").alias("mask"))


def merged(key: str, *parts: DataFrame) -> DataFrame:
    """(key, word, mask) of several: sets of tiles are joined word by word, in rows of fixed width."""
    union = reduce(DataFrame.unionByName, [p.select(key, "word", "mask") for p in parts])
    return union.groupBy(key, "word").agg(F.bit_or("mask").alias("mask"))


def spread(sets: DataFrame, key: str) -> DataFrame:
    """(key, tile) of (key, word, mask)."""
    bits = sets.select(key, "word", "mask", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return bits.where("(shiftright(mask, bit) & 1) = 1").select(key, (F.col("word") * 64 + F.col("bit")).alias("tile"))


def sets(pairs: DataFrame, key: str) -> DataFrame:
    """(key, word, mask) of (key, tile)."""
    return merged(key, words(pairs, key))


def with_below(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sets of relations, each joined with those of its descendants."""
    below = pairs.select(F.col("ancestor").alias("parent"), F.col("descendant").alias("rel")).join(own, "rel")
    return merged("rel", own, below.select(F.col("parent").alias("rel"), "word", "mask"))


def with_descendants(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rel, tile): each relation's tiles and those of its descendants."""
    return spread(with_below(sets(tiles, "rel"), pairs), "rel")


def to_ways(tiles: DataFrame, way_members: DataFrame, known: DataFrame) -> DataFrame:
    """(way, tile) that relations hand to their known ways."""
    handed = way_members.join(known.select("way"), "way", "left_semi").join(sets(tiles, "rel"), "rel")
    return spread(merged("way", handed), "way")


def to_nodes(tiles: DataFrame, node_members: DataFrame, tiles_of_ways: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, tile) that relations and ways hand to their known nodes; unknown ones go before their tiles are joined."""
    by_rel = node_members.join(known.select("node"), "node", "left_semi").join(sets(tiles, "rel"), "rel")
    through = refs.select("way", "node").join(known.select("node"), "node", "left_semi").join(sets(tiles_of_ways, "way"), "way")
    return spread(merged("node", by_rel, through), "node")


def incomplete(way_members: DataFrame, node_members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel) with a member that is not there."""
    no_way = way_members.join(ways.select("way"), "way", "left_anti").select("rel")
    no_node = node_members.join(nodes.select("node"), "node", "left_anti").select("rel")
    return no_way.unionByName(no_node).distinct()


def _chain(ends: list[tuple[int, int, int]]) -> list[int]:
    """Chain number of each (way, first, last), joined greedily at equal ends.

    The first open chain takes the last remaining way that fits either of its
    ends, again and again, until it closes or nothing fits.
    """
    fits: dict[int, list[int]] = defaultdict(list)
    for k, (_, a, b) in enumerate(ends):
        for end in {a, b}:
            fits[end].append(k)
    of = [-1] * len(ends)

    def last_free(end: int) -> int:
        ways = fits[end]
        while ways and of[ways[-1]] >= 0:
            ways.pop()
        return ways[-1] if ways else -1

    n = 0
    for at, (_, head, tail) in enumerate(ends):
        if of[at] >= 0:
            continue
        of[at] = n
        while head != tail:
            k = max(last_free(tail), last_free(head))
            if k < 0:
                break
            of[k] = n
            _, a, b = ends[k]
            if a == tail or b == tail:
                tail = b if a == tail else a
            else:
                head = b if a == head else a
        n += 1
    return of


def rings(members: DataFrame) -> DataFrame:
    """(rel, chain, way) from (rel, pos, way, role, first, last): outer ways joined to chains, relation by relation.

    A relation is one row of lists, so Python is called for batches of relations, not for each.
    """

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("way", "first", "last")]
            sizes = lists[0].value_lengths().to_pylist()
            way, *ends = (x.flatten() for x in lists)
            rows = list(zip(way.to_pylist(), *(x.to_pylist() for x in ends)))
            stops = list(accumulate(sizes))
            chain = [c for n, stop in zip(sizes, stops) for c in _chain(rows[stop - n : stop])]
            rel = np.repeat(batch.column("rel").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rel), pa.array(chain, pa.int32()), way], ["rel", "chain", "way"])

    outer = members.where("role <> 'inner'").groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("pos", "way", "first", "last"))).alias("m"))
    return outer.select("rel", "m.way", "m.first", "m.last").mapInArrow(many, "rel long, chain int, way long")


def ring_boxes(chains: DataFrame, boxes_of_ways: DataFrame) -> DataFrame:
    """(rel, chain, four edges) around each chain."""
    placed = chains.join(boxes_of_ways, "way")
    return placed.groupBy("rel", "chain").agg(
        F.min("min_lat").alias("min_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"), F.max("max_lon").alias("max_lon"),
    )
