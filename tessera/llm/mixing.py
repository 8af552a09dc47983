"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame expressions. Sources by code point (null last) weigh 1, 2, 3,
repeating, and share the whole size; a target stops at ``MAX_COPIES`` times its
source's size and the excess is reshared (water filling, closed form over the
sources ordered by size to weight).

The documents of a source fall into blocks by a hash of their id, about
``BLOCK_DOCS`` each, but into ``MIN_BLOCKS`` at least if it has as many documents. A source's exact quota is a number of block draws: every
block ``floor(target / size)`` times, then blocks in permuted order while they
fit, then single documents of the boundary blocks (about ``BLOCK_DOCS`` documents)
while they fit and one more if that comes nearer to the target. The draws are
dealt to ``shards`` output shards by a tree: at each node the left child's
number of draws of each source is a multivariate hypergeometric sample, taken
source by source from its conditional distribution (inverse cumulative sum in
a window of ten standard deviations around the mean, beyond which lies less
than the resolution of the uniform number). The leaves' quotas cut each
source's permuted draws into disjoint ranges, and within a shard documents
stand by a hash: the local shuffle.

Scale: block statistics are sums combined before the shuffle; the tables of
sources and blocks are small (a block row for about ``BLOCK_DOCS`` documents);
the join that hands draws back has (source, block) as its key, so a hot source
is spread over all its blocks. Uniform numbers are hashes, so reruns agree.

Defined results: null text has size 0; a source of size 0 has target 0; the
null source is a source of its own; rows that repeat a doc_id within a source
are drawn together in the boundary blocks; equal hashes go by block or id; very long texts
count whole; an empty table gives no rows; further columns are not read, whatever
their names, but for those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, table

MAX_COPIES = 3
BLOCK_DOCS = 512
MIN_BLOCKS = 64
SHARDS = 16
WEIGHTS = (1, 2, 3)
SEED = "mix"


def _hash32(*parts: Column) -> Column:
    """Uniform in 0 .. 2^32-1, from MD5, which SQL engines share."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *[F.col(c).alias(f"kept_{c}") for c in keep])


def targets(docs: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, weight, target) of sized documents."""
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # A window over sources, of which there are few: documents are already summed up.
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))))
    per = per.withColumn("weight", weight)
    full = F.col("source_size") * MAX_COPIES
    before = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(rest))
    # The first source, in this order, that is not stopped sets the level of all that follow.
    open_level = F.min(F.when(full > F.col("weight") * F.col("level"), F.struct((full / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)["level"]
    stopped = open_level.isNull() | (full <= F.col("weight") * F.col("level"))
    return per.withColumn("target", F.when(stopped, full.cast("double")).otherwise(F.col("weight") * open_level)).drop("level")


def _uniform(*parts: Column) -> Column:
    return (_hash32(*parts) + 0.5) / F.lit(float(1 << 32))


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` fall on ``good``; all are longs, u uniform in (0, 1)."""
    mean = draws * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1))) + 1) * 10
    lo = F.greatest(F.lit(0), draws + good - total, F.floor(mean - spread)).cast("long")
    hi = F.least(draws, good, F.ceil(mean + spread)).cast("long")

    def steps(body):
        """Relative weights from lo on by the ratio of neighbours; the mode may be e^50 above."""
        def step(s: Column, k: Column) -> Column:
            ratio = (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1)).cast("double")
            return body(s, s["w"] * ratio, k + 1)
        return step

    def total_of(lo_: Column, hi_: Column) -> Column:
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
        ks = F.when(hi_ > lo_, F.sequence(lo_, hi_ - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(ks, first, steps(lambda s, w, _: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))["sum"]

    def draw(lo_: Column, hi_: Column, sum_: Column) -> Column:
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), lo_.alias("k"))
        ks = F.when(hi_ > lo_, F.sequence(lo_, hi_ - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(ks, first, steps(lambda s, w, k: F.struct(
            w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["sum"] < u * sum_, k).otherwise(s["k"]).alias("k"),
        )))["k"]

    return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda b: let(total_of(b["lo"], b["hi"]), lambda s: draw(b["lo"], b["hi"], s)))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(rank, cuts array<long>) from (rank, quota): draws of each source below each shard's end.

    The tree's state is one row for a node with the quotas of all sources; the
    leaves are the shards, a power of two.
    """
    depth = shards.bit_length() - 1
    assert shards == 1 << depth, "the number of shards is a power of two"
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    for _ in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["quota"])

        def share(s: Column, x: Column) -> Column:
            # what is left of the node (total) and of its left child (draws) before this source
            got = _hypergeometric(s["total"], x["quota"], s["draws"], _uniform(F.lit("tree"), F.col("node"), x["rank"]))
            return F.struct(
                (s["total"] - x["quota"]).alias("total"),
                (s["draws"] - got).alias("draws"),
                F.concat(s["left"], F.array(got)).alias("left"),
            )

        start = F.struct(total.alias("total"), F.shiftright(total, 1).alias("draws"), F.array().cast("array<bigint>").alias("left"))
        left = F.aggregate("q", start, share)["left"]
        split = node.select("node", "q", left.alias("l"))
        node = split.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.transform("q", lambda x, i: F.struct(x["rank"].alias("rank"), F.get("l", i).alias("quota"))).alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.transform("q", lambda x, i: F.struct(x["rank"].alias("rank"), (x["quota"] - F.get("l", i)).alias("quota"))).alias("q")),
        )).alias("n")).select("n.*")
    leaf = node.select("node", F.explode("q").alias("x")).groupBy("x.rank").agg(F.array_sort(F.collect_list(F.struct("node", "x.quota"))).alias("parts"))
    cuts = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["quota"]))
    return leaf.select("rank", cuts.alias("cuts"))


def mix(docs: DataFrame, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, shards array<int>): a shard for each copy drawn; and the columns ``keep`` of docs."""
    base = sized(docs, keep)
    aims = targets(base.select("doc_id", "source", "size")).withColumns({
        "rank": F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())),
        "n_blocks": F.greatest(F.ceil(F.col("n_docs") / block_docs), F.least("n_docs", F.lit(MIN_BLOCKS))).cast("long"),
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumns({
        "rest": F.col("target") - F.col("whole") * F.col("source_size"),
        "span": F.ceil(F.col("n_blocks") * block_docs / F.col("n_docs")).cast("long"),
    })
    aims = aims.withColumnRenamed("source", "s_source")
    placed = base.join(aims, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    placed = placed.withColumn("block", F.pmod(_hash32(F.lit("block"), F.col("doc_id")), F.col("n_blocks")))

    # Permuted blocks of each source, with the words up to their ends.
    block = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("whole").alias("whole"), F.first("span").alias("span"))
    order = W.partitionBy("rank").orderBy(_hash32(F.lit("order"), F.col("rank"), F.col("block")), "block")
    block = block.withColumns({"upto": F.sum("words").over(order), "at": F.row_number().over(order)})
    source = W.partitionBy("rank")
    fits = F.col("upto") <= F.col("rest")
    block = block.withColumns({"fits": fits, "n_fit": F.sum(fits.cast("int")).over(source), "room": F.col("rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(source), F.lit(0))})
    block = block.withColumn("edge", ~F.col("fits") & (F.col("at") <= F.col("n_fit") + F.col("span")))
    block = block.withColumn("draws", F.col("whole") + F.when(F.col("fits"), 1).otherwise(0) + F.when(F.col("edge"), 1).otherwise(0))

    # Draws are numbered in another permutation; the tree cuts that order into shards.
    draw = block.where("draws > 0").select("rank", "block", "edge", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("copy"), "draws")
    deal = W.partitionBy("rank").orderBy(_hash32(F.lit("deal"), F.col("rank"), F.col("block"), F.col("copy")), "block", "copy")
    draw = draw.withColumn("at", F.row_number().over(deal) - 1)
    cuts = splitting_tree(draw.groupBy("rank").agg(F.count("*").alias("quota")), shards)
    draw = draw.join(cuts, "rank").withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("at"))))
    partial = F.col("edge") & (F.col("copy") == F.col("draws"))
    held = draw.groupBy("rank", "block").agg(
        F.array_sort(F.collect_list(F.when(~partial, F.col("shard")))).alias("shards"),
        F.max(F.when(partial, F.col("shard"))).alias("edge_shard"),
    )
    held = block.select("rank", "block", "room", "edge").join(held, ["rank", "block"], "left")

    # In the boundary blocks documents are taken in hash order while they fit; the last may be the nearest that does not.
    dealt = placed.join(held, ["rank", "block"])
    unit = dealt.where("edge").groupBy("rank", "doc_id").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    unit = unit.groupBy("rank").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct(_hash32(F.lit("doc"), F.col("doc_id")).alias("h"), "doc_id", "size"))).alias("units"))
    none = F.array().cast("array<struct<h:bigint,doc_id:bigint,size:bigint>>")
    start = F.struct(F.col("room").cast("double").alias("room"), none.alias("took"), none.alias("left"))
    fitted = F.aggregate("units", start, lambda s, x: F.when(
        x["size"] <= s["room"], F.struct((s["room"] - x["size"]).alias("room"), F.concat(s["took"], F.array(x)).alias("took"), s["left"].alias("left")),
    ).otherwise(F.struct(s["room"].alias("room"), s["took"].alias("took"), F.concat(s["left"], F.array(x)).alias("left"))))

    def with_nearest(s: Column) -> Column:
        """One more document, if the source comes nearer to its target with it than without."""
        near = F.array_min(F.transform(s["left"], lambda x: F.struct(F.abs(x["size"] - s["room"]).alias("miss"), x.alias("x"))))
        return F.when(near["miss"] < s["room"], F.concat(s["took"], F.array(near["x"]))).otherwise(s["took"])

    kept = F.transform(let(fitted, with_nearest), lambda x: F.struct(x["doc_id"].alias("id")))
    kept = unit.select(F.col("rank").alias("k_rank"), F.explode(kept).alias("k")).select("k_rank", F.col("k.id").alias("k_id"), F.lit(True).alias("k_in"))
    out = dealt.join(kept, F.col("edge") & (F.col("rank") == F.col("k_rank")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left")
    drawn = F.coalesce("shards", F.array().cast("array<int>"))
    drawn = F.when(F.col("k_in"), F.concat(drawn, F.array("edge_shard"))).otherwise(drawn)
    return out.select("doc_id", "source", "size", "source_size", "target", drawn.alias("shards"), *[F.col(f"kept_{c}").alias(c) for c in keep])


def place(copy: Column) -> Column:
    """Where a copy of a document stands in its shard: by this number."""
    return _hash32(F.lit("place"), F.col("doc_id"), copy)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself: (shard, place, doc_id, source, size), documents in shuffled order within their shard."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("shards").alias("copy", "shard"))
    return copies.select("shard", place(F.col("copy")).alias("place"), "doc_id", "source", "size")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"))


def _sql_hash(*parts: str) -> str:
    text = " || ':' || ".join(["'mix'", *parts])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM (
      SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
o AS (SELECT *, (SELECT min_by(level, 3 * source_size / weight) FROM l WHERE 3 * source_size > weight * level) AS open_level FROM l),
t AS (SELECT *, CASE WHEN open_level IS NULL OR 3 * source_size <= weight * level THEN CAST(3 * source_size AS DOUBLE) ELSE weight * open_level END AS target,
             CAST(greatest(ceil(n_docs / 512), least(n_docs, 64)) AS BIGINT) AS n_blocks FROM o),
a AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT doc_id, size, rank, source_size, target, whole, target - whole * source_size AS rest, CAST(ceil(n_blocks * 512 / n_docs) AS BIGINT) AS span,
             {_sql_hash("'block'", "doc_id")} % n_blocks AS block FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
b AS (SELECT rank, block, sum(size) AS words, first(rest) AS rest, first(span) AS span FROM p GROUP BY ALL),
c AS (SELECT *, sum(words) OVER w AS upto, row_number() OVER w AS nr FROM b WINDOW w AS (PARTITION BY rank ORDER BY {_sql_hash("'order'", "rank", "block")}, block)),
f AS (SELECT *, upto <= rest AS fits, sum(CAST(upto <= rest AS INT)) OVER (PARTITION BY rank) AS n_fit, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY rank), 0) AS room FROM c),
e AS (SELECT rank, block, fits, NOT fits AND nr <= n_fit + span AS edge, room FROM f),
u AS (SELECT p.rank, p.doc_id, p.size, e.room, row_number() OVER (PARTITION BY p.rank ORDER BY {_sql_hash("'doc'", "doc_id")}, doc_id) AS n
      FROM p JOIN e ON p.rank = e.rank AND p.block = e.block WHERE e.edge),
g AS (SELECT rank, doc_id, n, size <= room AS took, CASE WHEN size <= room THEN room - size ELSE room END AS room FROM u WHERE n = 1
      UNION ALL SELECT u.rank, u.doc_id, u.n, u.size <= g.room, CASE WHEN u.size <= g.room THEN g.room - u.size ELSE g.room END FROM g JOIN u ON u.rank = g.rank AND u.n = g.n + 1),
r AS (SELECT rank, arg_max(room, n) AS room FROM g GROUP BY rank),
m AS (SELECT rank, arg_min(n, (abs(size - room), n)) AS n FROM (SELECT u.rank, u.n, u.size, r.room FROM u JOIN g USING (rank, n) JOIN r USING (rank) WHERE NOT took AND abs(u.size - r.room) < r.room) GROUP BY rank)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST((whole + CASE WHEN e.fits THEN 1 WHEN e.edge AND (coalesce(g.took, false) OR coalesce(g.n = m.n, false)) THEN 1 ELSE 0 END) * p.size AS BIGINT) AS taken
FROM p JOIN e ON p.rank = e.rank AND p.block = e.block LEFT JOIN g ON g.rank = p.rank AND g.doc_id = p.doc_id LEFT JOIN m ON m.rank = p.rank
"""
