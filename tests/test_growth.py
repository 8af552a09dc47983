"""Steps of the distribution and of rings that have to grow with their input: sets as bits, one pass, batches."""

import random
import time

from pyspark.sql import functions as F

from tessera.operators import assign, distribute, multitile
from tessera.operators.lineage import stored
from tessera.plans.queries import QUERIES
from tessera.sources.derived import Graph

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_are_words_of_bits(spark):
    """a set of 64 tiles is one row of fixed width; numbers may be of any size and sign."""
    pairs = [(k, t) for k in (1, 2) for t in range(64)] + [(3, t) for t in (-65, -64, -1, 63, 64, 10**12)]
    df = spark.createDataFrame(pairs + pairs[:70], "way long, tile long")
    packed = multitile.sets(df, "way")
    assert packed.where("way < 3").count() == 2
    assert _rows(multitile.spread(packed, "way")) == sorted(pairs)


def test_stored_computes_once(spark):
    """a checkpoint ran the stage that it ended twice."""
    calls = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    out = stored(spark.range(100).mapInArrow(one, "id long"))
    assert out.count() == 100 and out.count() == 100 and calls.value == 100


def test_relations_hand_on_no_rows_of_lists(spark):
    """what relations gather from those below them travels as words, without lists of tiles."""
    tiles = spark.createDataFrame([(r, t) for r in range(4) for t in range(r, 64, 4)], "rel long, tile long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 0)], "ancestor long, descendant long")
    out = multitile.with_descendants(tiles, pairs)
    assert "collect" not in _plan(out)
    want = {(0, t) for t in range(64)} | {(r, t) for r in (1, 2) for t in range(r, 64, 4)} | {(3, t) for t in range(64) if t % 4 in (0, 3)}
    assert _rows(out) == sorted(want)


def test_closure_of_cycles(spark):
    """carrying on only the newest pairs finds every shortest path of at most the given depth."""
    rng = random.Random(5)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(36)} | {(100 + i, 101 + i) for i in range(20)}
    for depth in (1, 3, 15):
        want, level = {}, {(a, b) for a, b in edges}
        for d in range(1, depth + 1):
            for p in level:
                want.setdefault(p, d)
            level = {(a, c) for a, b in level for x, c in edges if x == b}
        got = multitile.closure(spark.createDataFrame(sorted(edges), "parent long, child long"), depth)
        assert {(a, b): d for a, b, d in got.collect()} == want


def test_ways_come_as_one_row(spark):
    """one join by node and one grouping by way; a way has its tiles, its ends and the line that may cross others."""
    tiles = spark.createDataFrame([(-3, 0, 0, 100, 100), (700, 0, 100, 100, 200)], "tile long, min_lat long, min_lon long, max_lat long, max_lon long")
    points = spark.createDataFrame([(1, 50, 50), (2, 50, 100), (3, 50, 500), (4, 60, 60)], "node long, mlat long, mlon long")
    refs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 3), (3, 0, 1), (3, 1, 9), (4, 0, 9), (5, 0, 9), (5, 1, 1), (5, 2, 4), (5, 3, 9)], "way long, pos long, node long")
    w = {r["way"]: r for r in assign.whole_ways(refs, assign.spots(points, tiles)).collect()}
    assert sorted(w) == [1, 2, 3, 5]
    assert {k: (sorted(r["tiles"]), r["outside"], r["closed"], sorted(r["nodes"])) for k, r in w.items()} == {
        1: ([-3, 700], False, False, [1, 2]), 2: ([-3], True, False, [1, 3]), 3: ([-3], False, False, [1]), 5: ([-3], False, True, [1, 4])}
    assert sorted(k for k, r in w.items() if r["line"]) == [1, 2]
    assert tuple(w[5]["box"]) == (50, 50, 60, 60) and w[1]["box"] is None


def test_numbers_of_tiles_do_not_matter(spark):
    """tiles with far and negative numbers give the same distribution."""
    g = Graph(spark, SF)
    wanted = g.relations.select(F.col("id").alias("rel")).where("rel % 3 = 0")
    e = distribute.Elements(g.points, g.refs, g.way_members, g.node_members, g.edges, wanted)
    plain = distribute.distribute_complete(e, g.tiles)
    far = distribute.distribute_complete(e, g.tiles.withColumn("tile", F.col("tile") * 1001 - 20000))
    for name in ("nodes", "ways", "relations"):
        back = getattr(far, name).withColumn("tile", ((F.col("tile") + 20000) / 1001).cast("long"))
        assert _rows(back) == _rows(getattr(plain, name))


def _greedy(ends):
    """The first open chain takes the last way that fits either end, by looking at all."""
    free, of, n = list(range(len(ends))), [-1] * len(ends), 0
    while free:
        at = free.pop(0)
        head, tail, of[at] = ends[at][1], ends[at][2], n
        while head != tail:
            k = next((k for k in reversed(free) if {ends[k][1], ends[k][2]} & {head, tail}), None)
            if k is None:
                break
            _, a, b = ends[k]
            if tail in (a, b):
                tail = b if a == tail else a
            else:
                head = b if a == head else a
            free.remove(k)
            of[k] = n
        n += 1
    return of


def test_chains_are_linear_and_the_same(spark):
    """chains are those of the greedy search, in time that follows the number of ways."""
    rng = random.Random(3)
    for _ in range(500):
        k = rng.randrange(1, 9)
        ends = [(i, rng.randrange(k), rng.randrange(k)) for i in range(rng.randrange(12))]
        assert multitile._chain(ends) == _greedy(ends)
    order = list(range(60_000))
    rng.shuffle(order)
    began = time.process_time()
    assert set(multitile._chain([(i, a, a + 1) for i, a in enumerate(order)])) == {0}
    assert time.process_time() - began < 10


def test_rings_call_python_for_batches(spark):
    """Python was called for each relation."""
    df = QUERIES["relation_rings"](spark, SF)
    assert "FlatMapGroupsInPandas" not in _plan(df) and df.count() > 0
    rows = [(r, p, 10 * r + p, "inner" if p == 3 else "outer", p % 3, (p + 1) % 3) for r in range(3) for p in range(5)]
    got = multitile.rings(spark.createDataFrame(rows, "rel long, pos long, way long, role string, first long, last long"))
    want = []
    for r in range(3):
        own = [(w, a, b) for rel, p, w, role, a, b in rows if rel == r and role != "inner"]
        want += [(r, c, w) for c, (w, _, _) in zip(_greedy(own), own)]
    assert _rows(got) == sorted(want)


def test_closed_ways_in_one_aggregation(spark):
    """no lists of refs, no list of pairs to be made distinct, and the derived nodes of a ring are read in one pass."""
    plan = _plan(QUERIES["closed_way_tiles"](spark, SF))
    assert "collect_list" not in plan and "collect_set" not in plan
    boxes = spark.createDataFrame([(1, 10, 10, 90_000, 90_000), (2, 32_760, 5, 32_770, 6)], "way long, min_lat long, min_lon long, max_lat long, max_lon long")
    tiles = spark.createDataFrame([(7, 0, 0, 80_000, 80_000), (8, 80_000, 0, 99_000, 99_000)], "tile long, min_lat long, min_lon long, max_lat long, max_lon long")
    assert _rows(assign.box_tiles(boxes, tiles, "way")) == [(1, 7), (1, 8), (2, 7)]
    assert "HashAggregate" not in _plan(assign.box_tiles(boxes, tiles, "way"))
