"""A map-shaped graph derived from the star schema, in integers only.

Nodes come from line items, ways from orders, relations from customers and
nations; tiles are a fixed grid and cities are suppliers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE_LAT, TILE_LON, TILES = 20480, 40960, 8
PARENT_ID = 10_000_000
PART_BYTES = 8 << 20


@dataclass
class Graph:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, mlat, mlon, way, pos). The pair (order, line number) repeats in the data, hence the grouping."""
        line = F.col("l_linenumber").cast("long")
        part, supp = F.min("l_partkey"), F.min("l_suppkey")
        items = self.table("lineitem")
        # Dealt by order alone, so that the joins with orders need no further shuffle; a task's share does not grow with the table.
        n = max(self.spark.sparkContext.defaultParallelism, items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // PART_BYTES)
        return items.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
            ((F.col("l_orderkey") * 7919) % 160000 + (part * 37) % 3000).alias("mlat"),
            ((F.col("l_orderkey") * 104729) % 320000 + (supp * 53 + line * 211) % 3000).alias("mlon"),
        ).select((F.col("l_orderkey") * 8 + line).alias("id"), "mlat", "mlon", F.col("l_orderkey").alias("way"), line.alias("pos"))

    @property
    def points(self) -> DataFrame:
        return self.nodes.select("id", "mlat", "mlon")

    @property
    def refs(self) -> DataFrame:
        """(way, pos, node) in the order of the way."""
        return self.nodes.join(self.table("orders").select(F.col("o_orderkey").alias("way")), "way").select("way", "pos", F.col("id").alias("node"))

    @property
    def ring_refs(self) -> DataFrame:
        """As ``refs``, but every fifth way with three nodes or more ends where it began."""
        way = W.partitionBy("way").orderBy("pos")
        seen = self.refs.withColumns({"i": F.row_number().over(way), "n": F.count("*").over(way.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
        own, closing = F.struct("pos", "node"), F.struct(F.lit(99).cast("long").alias("pos"), "node")
        both = F.when(F.expr("i = 1 AND n >= 3 AND way % 5 = 0"), F.array(own, closing)).otherwise(F.array(own))
        return seen.select("way", F.explode(both).alias("ref")).select("way", "ref.*")

    @property
    def ways(self) -> DataFrame:
        """(id, version, tags)."""
        o = self.table("orders")
        tags = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
            ("created_by", F.lit("derived")), ("status", F.col("o_orderstatus")), ("highway", F.col("o_orderpriority")), ("status", F.lit("second")),
        )])
        return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("int").alias("version"), tags.alias("tags"))

    @property
    def relations(self) -> DataFrame:
        """(id, tags): kinds by market segment, names by id."""
        c = self.table("customer")
        key = F.col("c_custkey")
        kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "multipolygon").when(F.col("c_mktsegment") == "BUILDING", "boundary") \
            .when(F.col("c_mktsegment") == "FURNITURE", "restriction:hgv").when(F.col("c_mktsegment") == "HOUSEHOLD", "route").otherwise("street")
        boundary = F.when(key % 3 == 0, "administrative").when(key % 3 == 1, "national_park")
        name_key = F.when(key % 4 == 0, "name").when(key % 4 == 1, "alt_name").when(key % 4 == 2, "int_name")

        def tag(k, v):
            return F.struct(k.alias("k"), v.alias("v"))

        tags = F.array(
            tag(F.lit("type"), kind),
            tag(F.when(F.col("c_mktsegment") == "BUILDING", F.when(boundary.isNotNull(), "boundary")), boundary),
            tag(F.when(F.col("c_mktsegment") == "BUILDING", "admin_level"), (key % 13).cast("string")),
            tag(name_key, F.col("c_name")),
            tag(F.when(key % 8 == 3, "postal_code"), key.cast("string")),
        )
        return c.select(key.alias("id"), F.filter(tags, lambda t: t["k"].isNotNull() & t["v"].isNotNull()).alias("tags"))

    @property
    def way_members(self) -> DataFrame:
        """(rel, way)."""
        return self.table("orders").select(F.col("o_custkey").alias("rel"), F.col("o_orderkey").alias("way"))

    @property
    def node_members(self) -> DataFrame:
        """(rel, node): the first node of every seventh way of a relation."""
        first = self.refs.where("way % 7 = 0").groupBy("way").agg(F.min_by("node", "pos").alias("node"))
        return first.join(self.way_members, "way").select("rel", "node")

    @property
    def edges(self) -> DataFrame:
        """(parent, child) between relations; it holds cycles."""
        c = self.table("customer").select(F.col("c_custkey").alias("parent"))
        n = c.agg(F.count("*").alias("n"))
        child = (F.col("parent") * 7 + 3) % n.scalar()
        return c.withColumn("child", child).where("parent % 4 <> 1")

    @property
    def parent_edges(self) -> DataFrame:
        return self.table("customer").select((F.col("c_nationkey").cast("long") + PARENT_ID).alias("parent"), F.col("c_custkey").alias("child"))

    @property
    def tiles(self) -> DataFrame:
        """(tile, min_lat, min_lon, max_lat, max_lon), 64 of them."""
        i, j = (F.col("id") / TILES).cast("long"), F.col("id") % TILES
        return self.spark.range(TILES * TILES).select(
            F.col("id").alias("tile"), (i * TILE_LAT).alias("min_lat"), (j * TILE_LON).alias("min_lon"),
            ((i + 1) * TILE_LAT).alias("max_lat"), ((j + 1) * TILE_LON).alias("max_lon"),
        )

    @property
    def cities(self) -> DataFrame:
        """(id, country, name, lat, lon, population)."""
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
        key = F.col("s_suppkey")
        return self.table("supplier").join(n, "s_nationkey").select(
            key.alias("id"), "country", F.col("s_name").alias("name"), ((key * 7919) % 160000).alias("lat"), ((key * 104729) % 320000).alias("lon"),
            F.expr("cast(s_acctbal as bigint)").alias("population"),
        )
