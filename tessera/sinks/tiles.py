"""One file a tile, elements in input order, one writer a tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import to_degrees
from ..sources.files import write_bytes
from ..sources.model import COLUMNS
from .codecs import ENCODERS, ENDINGS


def placed(elements: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements with the tile of each of their copies."""
    parts = [nodes.select(F.lit("n").alias("kind"), F.col("node").alias("id"), "tile"), ways.select(F.lit("w").alias("kind"), F.col("way").alias("id"), "tile"),
             relations.select(F.lit("r").alias("kind"), F.col("rel").alias("id"), "tile")]
    return elements.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["kind", "id"])


def write_tiles(located: DataFrame, tiles: DataFrame, folder: str, output: str = "pbf", versions: str = "remove") -> DataFrame:
    """Writes ``<map id>.<ending>`` files; returns (tile, path, n) as the files are written by an action.

    Elements are dealt by tile and sorted within a partition, so a task streams
    tile after tile and holds one tile's file. A tile has at most about its node
    budget, which is what bounds it.
    """
    if output == "simulate":
        return located.groupBy("tile").agg(F.lit("").alias("path"), F.count("*").alias("n"))
    if output not in ENCODERS:
        raise ValueError(f"output must be one of {sorted([*ENCODERS, 'simulate'])}")
    edges = {c: to_degrees(F.col(e)) for c, e in (("b0", "min_lat"), ("b1", "min_lon"), ("b2", "max_lat"), ("b3", "max_lon"))}
    boxes = tiles.select("tile", "map_id", *[v.alias(k) for k, v in edges.items()])
    rows = located.select("tile", *COLUMNS).join(boxes, "tile").withColumn("rank", F.expr("CASE kind WHEN 'n' THEN 0 WHEN 'w' THEN 1 ELSE 2 END"))
    encode, ending = ENCODERS[output], ENDINGS[output]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for c in ("refs", "members", "tags"):
                    pdf[c] = [None if x is None else list(x) for x in pdf[c]]
                yield from pdf.to_dict("records")

        for tile, group in groupby(records(), key=lambda e: e["tile"]):
            group = list(group)
            box = tuple(group[0][k] for k in ("b0", "b1", "b2", "b3"))
            path = f"{folder}/{group[0]['map_id']:08d}{ending}"
            write_bytes(path, encode(group, box, versions))
            yield pd.DataFrame({"tile": [tile], "path": [path], "n": [len(group)]})

    dealt = rows.repartition("tile").sortWithinPartitions("tile", "rank", "file_seq", "elem_seq")
    return dealt.mapInPandas(run, "tile long, path string, n long")
