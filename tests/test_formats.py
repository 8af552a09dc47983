"""Round trips through all map formats, and the small text formats."""

import bz2
import gzip
import zipfile

import pytest

from tessera.sinks.codecs import ENCODERS, ENDINGS, degree_text
from tessera.sources import files, model, osm, texts
from tessera.sources.osm_o5m import read_section, sections
from tessera.sources.osm_pbf import UnknownFeature, read_header
from tessera.sources.wire import field, read_int, read_uint, sint, uint

BOX = (49.5, -8.25, 50.5, 9.0)
TAGS = [{"k": "name", "v": "Straße & 'co' <x>"}, {"k": "created_by", "v": "me"}, {"k": "name", "v": "again"}]


def elements():
    out = [dict(kind="n", id=i, version=i % 3, lat=50 + i / 1e5, lon=-7.5 + i / 1e4, refs=None, members=None, tags=TAGS if i % 5 == 0 else []) for i in range(1, 2300)]
    out += [dict(kind="w", id=10**10 + i, version=2, lat=None, lon=None, refs=[i, i + 1, 5, i], members=None, tags=TAGS[:1]) for i in range(1, 40)]
    members = [dict(type=t, ref=r, role=x) for t, r, x in (("way", 10**10 + 1, "outer"), ("node", 7, ""), ("relation", 3, "part"))]
    return out + [dict(kind="r", id=i, version=1, lat=None, lon=None, refs=None, members=members, tags=TAGS[:1] * 2) for i in range(1, 5)]


@pytest.mark.parametrize("kind", sorted(ENCODERS))
@pytest.mark.parametrize("policy", ["remove", "fake", "keep"])
def test_round_trip(spark, tmp_path, kind, policy):
    path = str(tmp_path / f"63240001{ENDINGS[kind]}")
    files.write_bytes(path, ENCODERS[kind](elements(), BOX, policy))
    got = osm.read_osm(spark, path).orderBy("kind", "elem_seq").collect()
    want = elements()
    for k in "nwr":
        a, b = [r for r in got if r["kind"] == k], [e for e in want if e["kind"] == k]
        assert [r["id"] for r in a] == [e["id"] for e in b]
        for r, e in zip(a, b):
            assert [(t["k"], t["v"]) for t in r["tags"]] == [(t["k"], t["v"]) for t in e["tags"]]
            if k == "n":
                assert abs(r["lat"] - e["lat"]) < 1e-7 and abs(r["lon"] - e["lon"]) < 1e-7
                version = {"remove": 0, "fake": 1, "keep": e["version"]}[policy]
                assert r["version"] == (max(1, version) if kind == "pbf" else version)
            if k == "w":
                assert r["refs"] == e["refs"]
            if k == "r":
                assert [tuple(m) for m in r["members"]] == [(m["type"], m["ref"], m["role"]) for m in e["members"]]
    b = [r for r in got if r["kind"] == "b"][0]
    assert (b["lat"], b["lon"], b["lat2"], b["lon2"]) == pytest.approx(BOX)


def test_typed_tables(spark, tmp_path):
    path = str(tmp_path / "a.osm.pbf")
    files.write_bytes(path, ENCODERS["pbf"](elements(), BOX))
    all_of = osm.read_osm(spark, path)
    n = model.nodes(all_of)
    assert n.count() == 2299
    first = n.where("id = 5").first()
    assert [t["k"] for t in first["tags"]] == ["name", "name"]
    assert first["mlat"] == int(first["lat"] * (1 << 24) / 360 + 0.5)
    ways, nodes, edges = model.relation_members(model.relations(all_of))
    assert (ways.count(), nodes.count(), edges.count()) == (4, 4, 4)
    assert model.way_refs(model.ways(all_of)).count() == 39 * 4
    assert osm.read_osm(spark, path, kinds="w").where("kind <> 'b'").select("kind").distinct().collect()[0][0] == "w"


def test_xml_rules(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_text("""<osm><bounds minlat='1' minlon='2' maxlat='3' maxlon='4'/><bound box='1,2,3,x'/>
    <node id='1' lat='1.5' lon='2.5'><tag k='a' v='b'/></node><node id='2' lat='1'/><node id='3' lat='1' lon='2' action='delete'/>
    <way id='4' version='7'><nd ref='1'/><nd ref='9'/></way>
    <relation id='5'><member type='way' ref='4'/><member type='odd' ref='4' role='x'/></relation></osm>""")
    rows = {(r["kind"], r["id"]): r for r in osm.read_osm(spark, str(path)).collect()}
    assert set(rows) == {("n", 1), ("w", 4), ("r", 5), ("b", None)}
    assert rows["w", 4]["version"] == 7 and rows["n", 1]["version"] == 0
    assert [tuple(m) for m in rows["r", 5]["members"]] == [("way", 4, "")]
    with gzip.open(f"{path}.gz", "wt") as f:
        f.write(path.read_text())
    assert osm.read_osm(spark, f"{path}.gz").count() == 4
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(path, "a.osm")
    plain, zipped = (sorted(map(str, osm.read_osm(spark, str(tmp_path / n)).drop("elem_seq").collect())) for n in ("a.osm", "a.zip"))
    assert plain == zipped


def test_o5m_skips_deletions_and_unknown_sets(tmp_path):
    body = b"\x10" + uint(1) + sint(5)  # a deletion: an id alone
    body += b"\x10" + uint(2) + sint(1) + b"\0"  # id and version
    body += b"\x77" + uint(3) + b"abc"
    node = sint(1) + b"\0" + sint(70) + sint(80)
    body += b"\x10" + uint(len(node)) + node
    path = tmp_path / "x.o5m"
    path.write_bytes(b"\xff\xe0\x04o5m2" + body + b"\xfe")
    (cut,) = sections(str(path))
    (e,) = read_section(path.read_bytes()[cut[0] : cut[1]])
    assert (e["id"], e["lon"], e["lat"]) == (7, 70 / 1e7, 80 / 1e7)
    path.write_bytes(b"\xff\xe0\x04abcd")
    with pytest.raises(ValueError):
        sections(str(path))


def test_pbf_unknown_feature():
    with pytest.raises(UnknownFeature):
        read_header(field(4, b"HistoricalInformation"))


def test_wire():
    for v in (0, 1, -1, 63, 64, -64, -65, 2**40, -(2**62)):
        assert read_int(sint(v), 0) == (v, len(sint(v)))
    assert read_uint(uint(300), 0) == (300, 2)


def test_compressed_texts(tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"gz"))
    (tmp_path / "a.bz2").write_bytes(bz2.compress(b"bz"))
    with zipfile.ZipFile(tmp_path / "sea.zip", "w") as z:
        z.writestr("other.txt", "no")
        z.writestr("sea_1.txt", "zip")
    assert [files.read_text(str(tmp_path / n)) for n in ("a.gz", "a.bz2", "sea.zip")] == ["gz", "bz", "zip"]


def test_degree_text():
    assert [degree_text(x) for x in (1.5, 0.5, -0.25, 0.0, -12.1234567)] == ["1.5000000", "0.5", "-0.25", "0", "-12.1234567"]


def test_areas_round_trips():
    tiles = [texts.Tile(63240001, -2048, 0x800, 4096, 8192, "DE-Town"), texts.Tile(63240002, 0, 0, 2048, 2048)]
    text = texts.areas_list(tiles)
    assert [t.__dict__ | {"name": None} for t in tiles] == [t.__dict__ for t in texts.parse_areas_list(text)]
    assert texts.parse_areas_list("63240001: 0x10,010 to 0x20,020")[0] == texts.Tile(63240001, 16, 10, 32, 20)
    assert [(t.map_id, t.min_lat, t.max_lon) for t in texts.parse_areas_kml(texts.areas_kml(tiles))] == [(t.map_id, t.min_lat, t.max_lon) for t in tiles]
    with pytest.raises(ValueError):
        texts.parse_areas_list("63240001: 10,10 to 5,20")


def test_poly_problem_ids_density(spark, tmp_path):
    name, rings = texts.parse_poly("area\n1\n 1 2\n 3 2\n 3 4\nEND\n!2\n 1.5 2.5\n 1.6 2.5\n 1.6 2.6\n 1.5 2.5\nEND\nEND\n")
    assert name == "area" and [r.hole for r in rings] == [False, True] and rings[0].points[-1] == (1.0, 2.0)
    assert texts.parse_poly(texts.poly(name, rings))[1] == rings
    assert texts.parse_problem_ids("way: 12 # x\n#c\nrel:7\n") == ([12], [7])
    with pytest.raises(ValueError):
        texts.parse_problem_ids("way 12\n")
    cells = spark.createDataFrame([(1, 2, 3), (0, 5, 7), (0, 1, 0)], "x int, y int, n long")
    path = tmp_path / "densities.txt"
    path.write_text("\n".join([*texts.density_lines((0, 0, 9, 9), cells), ""]))
    box, back = texts.read_density(spark, str(path))
    assert box == (0, 0, 9, 9) and sorted(map(tuple, back.collect())) == [(0, 5, 7), (1, 2, 3)]


def test_cities_and_sea(spark, tmp_path):
    rows = "\t".join(["1", "Örtchen", "Oertchen", "", "50.0", "-7.5", "", "", "DE", "", "", "", "", "", "1200"])
    (tmp_path / "cities.txt").write_text(rows + "\nbad line\n")
    (c,) = texts.read_cities(spark, str(tmp_path / "cities.txt")).collect()
    assert (c["country"], c["name"], c["population"]) == ("DE", "Oertchen", 1200)
    (tmp_path / "index.txt").write_text("0_0;sea\n32768_0;land\n0_32768;a.osm.pbf\n-32768_0;b.osm.pbf\n")
    idx = texts.sea_index(spark, str(tmp_path / "index.txt"))
    assert [r["what"] for r in texts.sea_files(idx, (0, 0, 40000, 40000)).collect()] == ["a.osm.pbf"]
