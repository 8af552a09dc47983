"""Whole runs: options, tiles, complete objects, files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import tags
from tessera.operators import assign, multitile
from tessera.plans.options import Options, parse
from tessera.plans.run import polygon_descriptions, run
from tessera.sinks.codecs import ENCODERS
from tessera.sources import files, model, osm, texts
from tessera.sources.texts import parse_poly, read_areas

BOX = (49.0, 7.0, 51.0, 9.0)


def small_map(n=24_000):
    """Two dense towns, ways between and within them, relations over ways."""
    r = random.Random(3)
    e = []
    for i in range(1, n + 1):
        town = (49.5, 7.4) if i % 2 else (50.4, 8.6)
        lat, lon = (round(c + r.gauss(0, 0.08), 7) for c in town)
        e.append(dict(kind="n", id=i, version=1, lat=lat, lon=lon, refs=None, members=None, tags=[]))
    for i in range(1, 401):
        refs = [r.randint(1, n) for _ in range(r.randint(2, 6))]
        refs = refs + refs[:1] if i % 3 == 0 else refs
        e.append(dict(kind="w", id=i, version=1, lat=None, lon=None, refs=refs, members=None, tags=[{"k": "highway", "v": "road"}]))
    for i in range(1, 41):
        kind = ("multipolygon", "restriction", "route", "boundary")[i % 4]
        members = [dict(type="way", ref=r.randint(1, 400), role="outer") for _ in range(3)] + [dict(type="node", ref=r.randint(1, n), role="")]
        members += [dict(type="relation", ref=i % 40 + 1, role="")] if i % 5 == 0 else []
        e.append(dict(kind="r", id=i, version=1, lat=None, lon=None, refs=None, members=members, tags=[{"k": "type", "v": kind}]))
    return e


@pytest.fixture(scope="module")
def map_file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("map") / "in.osm.pbf")
    files.write_bytes(path, ENCODERS["pbf"](small_map(), BOX, "keep"))
    return path


def test_complete_run(spark, map_file, tmp_path):
    out = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path), write_kml="areas.kml", problem_report="problems.txt", output="o5m"))
    tiles = out.tiles
    assert len(tiles) >= 2
    assert [t.map_id for t in read_areas(str(tmp_path / "areas.list"))] == [t.map_id for t in tiles] == [t.map_id for t in read_areas(str(tmp_path / "areas.kml"))]
    e = small_map()
    nodes_of = {x["id"]: set(x["refs"]) for x in e if x["kind"] == "w"}
    nt, wt = {}, {}
    for r in out.tiled.nodes.collect():
        nt.setdefault(r["tile"], set()).add(r["node"])
    for r in out.tiled.ways.collect():
        wt.setdefault(r["tile"], set()).add(r["way"])
    problem = {r["way"] for r in out.tiled.problem_ways.collect()}
    assert problem
    for tile, ways in wt.items():
        for w in ways & problem:
            assert nodes_of[w] <= nt[tile]  # whole in each of its tiles
    written = {r["tile"]: r for r in out.written.collect()}
    for tile, r in written.items():
        got = osm.read_osm(spark, r["path"]).where("kind <> 'b'")
        kinds = [x["kind"] for x in got.orderBy("elem_seq").collect()]
        assert r["n"] == len(kinds) and kinds == sorted(kinds, key="nwr".index)
    assert sum(r["n"] for r in written.values()) == out.tiled.nodes.count() + out.tiled.ways.count() + out.tiled.relations.count()
    report = (tmp_path / "problems.txt").read_text().split("\n")
    again = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path / "b"), split_file=str(tmp_path / "areas.list"), stop_after="gen-problem-list", problem_report="p.txt"))
    assert (tmp_path / "b" / "p.txt").read_text().split("\n") == report and len(again.tiles) == len(tiles)


def test_plain_run_and_parquet(spark, map_file, tmp_path):
    out = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path), keep_complete=False, output="parquet"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == out.tiled.nodes.count() + out.tiled.ways.count() + out.tiled.relations.count()
    assert out.options.grown_by == 2000


def test_wanted_tiles_and_polygon(spark, map_file, tmp_path):
    assert len(run(spark, Options([map_file], num_tiles=4, output_dir=str(tmp_path), stop_after="split")).tiles) in (3, 4, 5)
    (tmp_path / "a.poly").write_text("a\n1\n 7 49\n 8 49\n 8 50\n 7 50\nEND\nEND\n")
    o = Options([map_file], mapid=63240100, max_nodes=10_000, polygon_file=str(tmp_path / "a.poly"), output_dir=str(tmp_path), stop_after="split", write_kml="t.kml")
    tiles = run(spark, o).tiles
    assert tiles and all(t.max_lon * 360 / 2**24 < 8.2 for t in tiles)
    # the polygon is a box, so tiles end exactly at it
    assert {max(t.max_lat for t in tiles), max(t.max_lon for t in tiles)} <= {round(50 * 2**24 / 360), round(8 * 2**24 / 360)}
    assert [t.map_id for t in read_areas(str(tmp_path / "a-t.kml"))] == [t.map_id for t in tiles]
    lines = (tmp_path / "a-template.args").read_text().splitlines()
    assert [x for x in lines if x.startswith("mapname")] == [f"mapname: {63240101 + i:08d}" for i in range(len(tiles))]
    assert parse_poly((tmp_path / "a-areas.poly").read_text())[1]


def test_densities_are_written_and_reused(spark, map_file, tmp_path, monkeypatch):
    first = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path / "a"), stop_after="split")).tiles
    text = (tmp_path / "a" / "densities-out.txt").read_text().splitlines()
    assert sum(int(x.split(",")[2]) for x in text[2:]) == 24_000
    by_option = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path / "b"), stop_after="split", density_file=str(tmp_path / "a" / "densities-out.txt"))).tiles
    (tmp_path / "a" / "densities-out.txt").rename(tmp_path / "densities.txt")
    monkeypatch.chdir(tmp_path)
    by_name = run(spark, Options([map_file], max_nodes=10_000, output_dir=str(tmp_path / "c"), stop_after="split")).tiles
    assert first == by_option == by_name and not (tmp_path / "c" / "densities-out.txt").exists()


def test_invalid_bounds_and_bad_cities(spark, tmp_path):
    rows = [("b", 5.0, 1.0, 2.0, 3.0)]
    with pytest.raises(Exception, match="invalid bounds"):
        model.bounds(spark.createDataFrame([(*r, 0) for r in rows], "kind string, lat double, lon double, lat2 double, lon2 double, file_seq int")).collect()
    good = "\t".join(["1", "A", "A", "", "1.5", "2.5", "P", "PPL", "DE", "", "", "", "", "", "100"])
    (tmp_path / "c.txt").write_text(good + "\nno city\n\n")
    assert texts.read_cities(spark, str(tmp_path / "c.txt")).count() == 1
    assert [r["value"] for r in texts.bad_cities(spark, str(tmp_path / "c.txt")).collect()] == ["no city", ""]


def test_all_of_repeated_tags_count(spark):
    cases = [
        ([("type", "x"), ("type", "restriction")], True), ([("type", "multipolygon"), ("boundary", "political"), ("boundary", "park")], False),
        ([("type", "multipolygon"), ("boundary", "park"), ("admin_level", "4")], True), ([("type", "multipolygon"), ("boundary", "political"), ("admin_level", "3"), ("admin_level", "6")], True),
        ([("boundary", "park")], False), ([], False), ([("type", "boundary")], True),
    ]
    df = spark.createDataFrame([(i, [{"k": k, "v": v} for k, v in t]) for i, (t, _) in enumerate(cases)], "i int, tags array<struct<k:string,v:string>>")
    got = df.select("i", tags.wanted_relation(F.col("tags")).alias("used")).orderBy("i").collect()
    assert [r["used"] for r in got] == [used for _, used in cases]


def test_polygon_descriptions(spark, tmp_path):
    path = tmp_path / "p.osm"
    path.write_text("<osm><node id='1' lat='1' lon='1'/><node id='2' lat='1' lon='2'/><node id='3' lat='2' lon='2'/><way id='9'><nd ref='1'/><nd ref='2'/><nd ref='3'/><nd ref='1'/><tag k='name' v='X'/><tag k='mapid' v='42'/></way><way id='10'><nd ref='1'/><tag k='name' v='no id'/></way></osm>")
    ((name, map_id, rings),) = polygon_descriptions(spark, str(path), 13)
    assert (name, map_id, len(rings[0].points)) == ("X", 42, 4)
    assert all(v % 2048 == 0 for p in rings[0].points for v in p)


def test_missing_input_writes_nothing(spark, tmp_path):
    with pytest.raises(Exception):
        run(spark, Options([str(tmp_path / "none.osm.pbf")], output_dir=str(tmp_path)))
    assert not (tmp_path / "areas.list").exists()


def test_options():
    o = parse(["--status-freq=0", "--max-nodes=1_000_000", "--keep-complete=false", "--no-trim", "a.pbf", "--boundary-tags=national_park, political"])
    assert (o.max_nodes, o.keep_complete, o.no_trim, o.files, o.boundaries) == (1_000_000, False, True, ["a.pbf"], ("national_park", "political"))
    for bad in ("--mapid=100000000", "--max-nodes=9", "--num-tiles=1", "--resolution=25", "--max-areas=0", "--search-limit=9", "--wanted-admin-level=13", "--output=pb", "--stop-after=x", "--handle-element-version=y"):
        with pytest.raises(ValueError):
            parse([bad])
    with pytest.raises(ValueError):
        parse(["--polygon-file=a", "--polygon-desc-file=b"])
    with pytest.raises(ValueError):
        parse(["--mixed=true"])
    with pytest.warns(UserWarning):
        parse(["--cache=x", "--max-nodes=20000", "--max-nodes=30000"])


def test_ring_chains():
    assert multitile._chain([(1, 1, 2), (2, 5, 6), (3, 2, 3), (4, 3, 1), (5, 6, 5)]) == [0, 1, 0, 0, 1]
    assert multitile._chain([(1, 1, 2), (2, 3, 2)]) == [0, 0]
    assert multitile._chain([(1, 1, 1), (2, 1, 2)]) == [0, 1]


def test_crossing_needs_no_node(spark):
    """A way over a tile without a node in it gets that tile, if it is in two tiles anyway."""
    tiles = spark.createDataFrame([(i, 0, i * 100, 100, i * 100 + 100) for i in range(3)], "tile long, min_lat long, min_lon long, max_lat long, max_lon long")
    placed = spark.createDataFrame([(1, 0, 10, 50, 10), (1, 1, 11, 50, 290), (2, 0, 12, 50, 20), (2, 1, 13, 50, 30)], "way long, pos long, node long, mlat long, mlon long")
    nt = assign.node_tiles(placed.selectExpr("node AS id", "mlat", "mlon"), tiles)
    assert sorted(map(tuple, assign.open_way_tiles(placed, nt, tiles).collect())) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    closed = spark.createDataFrame([("0,2",)], "tiles string")
    assert sorted(map(tuple, assign.open_way_tiles(placed, nt, tiles, closed).collect())) == [(1, 0), (1, 2), (2, 0)]


def test_result_does_not_depend_on_cells(spark):
    tiles = spark.createDataFrame([(0, -70000, -5, 3, 90000), (1, 0, 0, 40000, 40000)], "tile long, min_lat long, min_lon long, max_lat long, max_lon long")
    points = spark.createDataFrame([(1, 0, 0), (2, -70000, 90000), (3, 40000, 40000), (4, 3, -5), (5, 4, -5)], "id long, mlat long, mlon long")
    want = [(1, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    for shift in (4, 12, 20):
        assert sorted(map(tuple, assign.node_tiles(points, tiles, shift=shift).collect())) == want
