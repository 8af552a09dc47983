"""The same queries as plain SQL on the driver's tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

BASE = """WITH RECURSIVE nodes AS MATERIALIZED (SELECT l_orderkey * 8 + l_linenumber AS id,
  (l_orderkey * 7919) % 160000 + (min(l_partkey) * 37) % 3000 AS mlat,
  (l_orderkey * 104729) % 320000 + (min(l_suppkey) * 53 + l_linenumber * 211) % 3000 AS mlon,
  l_orderkey AS way, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem GROUP BY l_orderkey, l_linenumber),
refs AS MATERIALIZED (SELECT way, pos, id AS node FROM nodes JOIN orders ON way = o_orderkey),
firsts AS MATERIALIZED (SELECT way, arg_min(node, pos) AS first, arg_max(node, pos) AS last, count(*) AS n FROM refs GROUP BY way),
ring_refs AS MATERIALIZED (SELECT * FROM refs UNION ALL SELECT way, 99, first FROM firsts WHERE way % 5 = 0 AND n >= 3),
tiles AS MATERIALIZED (SELECT i * 8 + j AS tile, i * 20480 AS min_lat, j * 40960 AS min_lon, (i + 1) * 20480 AS max_lat, (j + 1) * 40960 AS max_lon FROM range(8) a(i), range(8) b(j)),
small AS MATERIALIZED (SELECT tile, min_lat - tile * 37 AS min_lat, min_lon + tile * 11 AS min_lon, max_lat - tile % 5 * 20480 AS max_lat, max_lon + tile % 3 * 5000 AS max_lon FROM tiles),
way_members AS MATERIALIZED (SELECT o_custkey AS rel, o_orderkey AS way FROM orders),
node_members AS MATERIALIZED (SELECT rel, first AS node FROM firsts JOIN way_members USING (way) WHERE way % 7 = 0),
edges AS MATERIALIZED (SELECT c_custkey AS parent, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS child FROM customer WHERE c_custkey % 4 <> 1),
nt AS MATERIALIZED (SELECT id AS node, tile FROM nodes, tiles WHERE mlat BETWEEN min_lat AND max_lat AND mlon BETWEEN min_lon AND max_lon),
wt AS MATERIALIZED (SELECT DISTINCT way, tile FROM refs JOIN nt USING (node)),
rt AS MATERIALIZED (SELECT rel, tile FROM node_members JOIN nt USING (node) UNION SELECT rel, tile FROM way_members JOIN wt USING (way)),
placed AS MATERIALIZED (SELECT refs.way, refs.pos, refs.node, mlat, mlon FROM refs JOIN nodes ON id = node),
wb AS MATERIALIZED (SELECT way, min(mlat) AS min_lat, min(mlon) AS min_lon, greatest(max(mlat), min(mlat) + 1) AS max_lat, greatest(max(mlon), min(mlon) + 1) AS max_lon FROM placed GROUP BY way),
seg AS MATERIALIZED (SELECT way, row_number() OVER w - 1 AS seq, lag(mlat) OVER w AS y1, lag(mlon) OVER w AS x1, mlat AS y2, mlon AS x2 FROM placed WINDOW w AS (PARTITION BY way ORDER BY pos)),
grown AS MATERIALIZED (SELECT tile, min_lat - 1 AS min_lat, min_lon - 1 AS min_lon, max_lat + 1 AS max_lat, max_lon + 1 AS max_lon FROM tiles),
crossed AS MATERIALIZED (SELECT DISTINCT way, tile FROM (SELECT *, (x2-x1)*(min_lat-y1)-(y2-y1)*(min_lon-x1) AS a, (x2-x1)*(min_lat-y1)-(y2-y1)*(max_lon-x1) AS b,
    (x2-x1)*(max_lat-y1)-(y2-y1)*(min_lon-x1) AS c, (x2-x1)*(max_lat-y1)-(y2-y1)*(max_lon-x1) AS d FROM seg, grown
    WHERE y1 IS NOT NULL AND least(y1, y2) <= max_lat AND greatest(y1, y2) >= min_lat AND least(x1, x2) <= max_lon AND greatest(x1, x2) >= min_lon)
  WHERE least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0),
boxed AS MATERIALIZED (SELECT DISTINCT way, tile FROM wb, grown g WHERE wb.min_lat < g.max_lat AND wb.max_lat > g.min_lat AND wb.min_lon < g.max_lon AND wb.max_lon > g.min_lon),
exact AS MATERIALIZED (SELECT way, tile FROM wt UNION SELECT crossed.way, tile FROM crossed JOIN (SELECT way FROM wt GROUP BY way HAVING count(*) > 1) USING (way)),
cells AS MATERIALIZED (SELECT least(mlon >> 11, 159) AS x, least(mlat >> 11, 79) AS y, count(*) AS n FROM nodes GROUP BY 1, 2),
city AS MATERIALIZED (SELECT s_suppkey AS id, n_name AS country, s_name AS name, (s_suppkey * 7919) % 160000 AS lat, (s_suppkey * 104729) % 320000 AS lon, CAST(trunc(s_acctbal) AS BIGINT) AS population FROM supplier JOIN nation ON n_nationkey = s_nationkey),
city_tile AS MATERIALIZED (SELECT tile, city.* FROM city, tiles WHERE lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon),
best AS MATERIALIZED (SELECT tile, arg_max(country || '-' || name, (population, -id)) AS name FROM city_tile GROUP BY tile),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tile) - 1 + 63240001 AS map_id FROM tiles WHERE tile IN (SELECT tile FROM nt)),
rels AS MATERIALIZED (SELECT c_custkey AS rel, c_name, c_mktsegment AS seg, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'multipolygon' WHEN 'BUILDING' THEN 'boundary' WHEN 'FURNITURE' THEN 'restriction:hgv' WHEN 'HOUSEHOLD' THEN 'route' ELSE 'street' END AS type,
  CASE WHEN c_mktsegment = 'BUILDING' THEN CASE c_custkey % 3 WHEN 0 THEN 'administrative' WHEN 1 THEN 'national_park' END END AS boundary,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 13 END AS level FROM customer),
used AS MATERIALIZED (SELECT rel, type IN ('restriction:hgv', 'street') OR type IN ('multipolygon', 'boundary') AND (boundary IS NULL OR boundary <> 'administrative' OR coalesce(level BETWEEN 5 AND 11, false)) AS used,
  type IN ('restriction:hgv', 'street') OR type IN ('multipolygon', 'boundary') AND (boundary IS NULL OR boundary = 'administrative' OR coalesce(level BETWEEN 9 AND 11, false)) AS administrative,
  type IN ('multipolygon', 'boundary') AS area FROM rels),
pw AS MATERIALIZED (SELECT way FROM wt GROUP BY way HAVING count(*) > 1),
ra AS MATERIALIZED (SELECT rel, tile FROM rt WHERE rel IN (SELECT rel FROM used WHERE used)),
pr AS MATERIALIZED (SELECT rel FROM ra GROUP BY rel HAVING count(*) > 1),
single AS MATERIALIZED (SELECT rel, min(tile) AS tile FROM ra GROUP BY rel HAVING count(*) = 1),
paths AS (SELECT parent AS a, child AS b, 1 AS d FROM edges UNION SELECT a, child, d + 1 FROM paths JOIN edges ON parent = b WHERE d < 15),
closure AS MATERIALIZED (SELECT DISTINCT a AS ancestor, b AS descendant FROM paths),
cl AS MATERIALIZED (SELECT rel FROM pr UNION SELECT descendant FROM closure WHERE ancestor IN (SELECT rel FROM pr)),
nw AS MATERIALIZED (SELECT way FROM pw UNION SELECT way FROM way_members WHERE rel IN (SELECT rel FROM cl)),
wt0 AS MATERIALIZED (SELECT way, tile FROM exact WHERE way IN (SELECT way FROM nw)),
rt0 AS MATERIALIZED (SELECT rel, tile FROM node_members JOIN nt USING (node) WHERE rel IN (SELECT rel FROM cl) UNION SELECT rel, tile FROM way_members JOIN wt0 USING (way) WHERE rel IN (SELECT rel FROM cl)),
rtx AS MATERIALIZED (SELECT rel, tile FROM rt0 UNION SELECT ancestor, tile FROM closure JOIN rt0 ON rel = descendant WHERE ancestor IN (SELECT rel FROM cl)),
wt1 AS MATERIALIZED (SELECT way, tile FROM wt0 UNION SELECT m.way, tile FROM way_members m JOIN rtx USING (rel) WHERE m.way IN (SELECT way FROM refs)),
nx AS MATERIALIZED (SELECT node, tile FROM refs JOIN wt1 USING (way) WHERE refs.way IN (SELECT way FROM nw) UNION SELECT node, tile FROM node_members JOIN rtx USING (rel)),
fw AS MATERIALIZED (SELECT way, tile FROM wt1 UNION SELECT way, tile FROM wt WHERE way NOT IN (SELECT way FROM wt1)),
fr AS MATERIALIZED (SELECT rel, tile FROM node_members JOIN nt USING (node) UNION SELECT rel, tile FROM way_members JOIN fw USING (way)),
frel AS MATERIALIZED (SELECT rel, tile FROM single UNION ALL SELECT rel, tile FROM rtx WHERE rel NOT IN (SELECT rel FROM single)
  UNION ALL SELECT rel, tile FROM fr WHERE rel NOT IN (SELECT rel FROM single) AND rel NOT IN (SELECT rel FROM rtx)),
ont AS MATERIALIZED (SELECT id AS node, tile FROM nodes, tiles WHERE mlat BETWEEN min_lat - 2000 AND max_lat + 2000 AND mlon BETWEEN min_lon - 2000 AND max_lon + 2000),
owt AS MATERIALIZED (SELECT DISTINCT way, tile FROM refs JOIN ont USING (node)),
ort AS MATERIALIZED (SELECT rel, tile FROM node_members JOIN ont USING (node) UNION SELECT rel, tile FROM way_members JOIN owt USING (way))
"""


def _add(**queries: str) -> None:
    ORACLES.update({k: BASE + v for k, v in queries.items()})


_PAIR = "FROM small a, small b"
_OVER = "{a}.min_lat < {b}.max_lat AND {a}.max_lat > {b}.min_lat AND {a}.min_lon < {b}.max_lon AND {a}.max_lon > {b}.min_lon"
_MAP8 = "lpad(CAST(map_id AS VARCHAR), 8, '0')"
_NO_NODES = "SELECT DISTINCT rel FROM way_members WHERE way NOT IN (SELECT way FROM refs)"

_add(
    nodes_projected="SELECT id, mlat, mlon FROM nodes",
    map_units="""SELECT event_id AS id, CAST(trunc((deg + CASE WHEN deg > 0 THEN 1 ELSE -1 END * (180.0::DOUBLE / 16777216)) * 16777216.0::DOUBLE / 360.0::DOUBLE) AS BIGINT) AS unit
      FROM (SELECT event_id, CAST(event_id % 360001 - 180000 AS DOUBLE) / 1000.0::DOUBLE AS deg FROM events)""",
    degrees_rounded="SELECT id, round(360.0::DOUBLE * mlat / 16777216, 6) AS lat, round(360.0::DOUBLE * mlon / 16777216, 6) AS lon FROM nodes",
    round_down_up_nearest="SELECT id, ((mlat - 80000) >> 11) * 2048 AS down, ((mlat - 80000 + 2047) >> 11) * 2048 AS up, ((mlat - 80000 + 2) >> 2) * 4 AS near FROM nodes",
    area_rounded="""SELECT tile, (greatest(min_lat, -3961287) >> 11) * 2048 AS min_lat, greatest((min_lon >> 11) * 2048, -8388608) AS min_lon,
      ((least(CASE WHEN max_lat = min_lat THEN max_lat + 1 ELSE max_lat END, 3961287) + 2047) >> 11) * 2048 AS max_lat,
      least(((CASE WHEN max_lon = min_lon THEN max_lon + 1 ELSE max_lon END + 2047) >> 11) * 2048, 8388608) AS max_lon FROM small""",
    box_relations=f"""SELECT a.tile AS a, b.tile AS b, b.min_lat >= a.min_lat AND b.max_lat <= a.max_lat AND b.min_lon >= a.min_lon AND b.max_lon <= a.max_lon AS a_contains_b,
      a.min_lat <= b.max_lat AND a.max_lat >= b.min_lat AND a.min_lon <= b.max_lon AND a.max_lon >= b.min_lon AS touching, {_OVER.format(a='a', b='b')} AS overlapping {_PAIR}""",
    box_intersection=f"""SELECT * FROM (SELECT a.tile AS a, b.tile AS b, greatest(a.min_lat, b.min_lat) AS min_lat, greatest(a.min_lon, b.min_lon) AS min_lon,
      least(a.max_lat, b.max_lat) AS max_lat, least(a.max_lon, b.max_lon) AS max_lon {_PAIR}) WHERE min_lat <= max_lat AND min_lon <= max_lon""",
    box_verify="SELECT tile, min_lat <= max_lat AND min_lon <= max_lon AND min_lat >= -4194304 AND max_lat <= 4194304 AND min_lon >= -8388608 AND max_lon <= 8388608 AS valid FROM small",
    bounds_union="SELECT tile % 4 AS file, min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM small WHERE min_lat <= max_lat AND min_lon <= max_lon GROUP BY 1",
    area_text="SELECT tile, printf('0x%x,0x%x,0x%x,0x%x', min_lat, min_lon, max_lat, max_lon) AS hexes, format('{:,}', max_lon * 10) AS thousands FROM tiles",
    node_validity="SELECT event_id AS id, event_id % 400 - 200 AS lon FROM events WHERE event_id % 400 - 200 NOT BETWEEN -180 AND 180",
    parsed_doubles="SELECT c_custkey AS id, CAST(c_custkey || '.' || (c_custkey * 7919 % 1000003) AS DOUBLE) AS value FROM customer",
    sea_raster="SELECT id, ((mlon - 100000) >> 15) * 32768 AS start, ((mlon - 100000 + 32767) >> 15) * 32768 AS stop FROM nodes",
    aspect_ratio="""SELECT tile, round((max_lon - min_lon) * greatest(cos(radians(360.0::DOUBLE * min_lat / 16777216)), cos(radians(360.0::DOUBLE * max_lat / 16777216))) / (max_lat - min_lat), 6) AS ratio FROM tiles""",
    tags_clean="SELECT o_orderkey AS id, 3::BIGINT AS n_tags, 'status=' || o_orderstatus || ';highway=' || o_orderpriority || ';status=second' AS text FROM orders",
    tag_first="SELECT o_orderkey AS id, o_orderstatus AS value, true AS absent FROM orders",
    relation_filter="SELECT rel, used, administrative, area FROM used",
    relation_names="SELECT rel, CASE WHEN rel % 4 IN (0, 1, 2) THEN c_name WHEN rel % 8 = 3 THEN 'postal_code=' || rel ELSE '?' END AS name FROM rels",
    xml_escaped="SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), chr(39), '&apos;'), '<', '&lt;'), chr(10), '&#xA;'), chr(13), '&#xD;'), chr(9), '&#x9;') AS escaped FROM documents",
    version_policy="SELECT o_orderkey AS id, 0::BIGINT AS remove, 1::BIGINT AS fake, o_orderkey % 7 AS keep FROM orders",
    density_cells="SELECT * FROM cells",
    density_total_max="SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS most, count(*) AS cells FROM cells",
    density_subset="SELECT x - 10 AS x, y - 5 AS y, n FROM cells WHERE x BETWEEN 10 AND 89 AND y BETWEEN 5 AND 59",
    density_columns="SELECT x, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY x",
    density_rows="SELECT y, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY y",
    density_cumulative="SELECT x, CAST(sum(sum(n)) OVER (ORDER BY x) AS BIGINT) AS running FROM cells GROUP BY x",
    density_gaps="SELECT prev + 1 AS start, x - prev - 1 AS len FROM (SELECT x, lag(x) OVER (ORDER BY x) AS prev FROM (SELECT x FROM cells GROUP BY x HAVING sum(n) >= (SELECT avg(n) FROM (SELECT sum(n) AS n FROM cells GROUP BY x)))) WHERE x - prev > 1",
    density_dump="SELECT x || ',' || y || ',' || n AS line FROM cells",
    data_bbox="SELECT min(mlat) AS min_lat, min(mlon) AS min_lon, max(mlat) AS max_lat, max(mlon) AS max_lon FROM nodes",
    sea_merge="""SELECT coalesce(c.x, s.x) AS x, coalesce(c.y, s.y) AS y, coalesce(c.n, 2 * s.n) AS n FROM cells c
      FULL JOIN (SELECT user_id % 160 AS x, event_id % 80 AS y, count(*) AS n FROM events GROUP BY 1, 2) s ON c.x = s.x AND c.y = s.y""",
    polygon_shares="""SELECT share, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (SELECT x, y, any_value(n) AS n, string_agg('p' || i, ',' ORDER BY i) AS share
      FROM cells, range(3) p(i) WHERE x >= i * 30 AND x < i * 30 + 70 AND y >= i * 10 AND y < i * 10 + 50 GROUP BY x, y) GROUP BY share""",
    node_tiles="SELECT node, tile FROM nt",
    node_tiles_overlap="SELECT node, tile FROM ont",
    tile_node_counts="SELECT tile, count(*) AS n FROM nt GROUP BY tile",
    way_tiles="SELECT way, tile FROM wt",
    way_tile_sets="SELECT way, string_agg(tile, ',' ORDER BY tile) AS tiles FROM wt GROUP BY way",
    tile_set_dictionary="SELECT tiles, row_number() OVER (ORDER BY tiles) AS rank, count(*) AS n FROM (SELECT way, string_agg(tile, ',' ORDER BY tile) AS tiles FROM wt GROUP BY way) GROUP BY tiles",
    way_bbox="SELECT * FROM wb",
    way_closed="SELECT way, n > 1 AND first = last AS closed FROM (SELECT way, arg_min(node, pos) AS first, arg_max(node, pos) AS last, count(*) AS n FROM ring_refs GROUP BY way)",
    way_ends="SELECT way, first, last FROM (SELECT way, arg_min(node, pos) AS first, arg_max(node, pos) AS last, count(*) AS n FROM ring_refs GROUP BY way) WHERE n >= 2",
    ring_orientation="""SELECT way, sum(x1 * y2 - x2 * y1) <= 0 AS clockwise FROM (SELECT r.way, lag(mlon) OVER w AS x1, lag(mlat) OVER w AS y1, mlon AS x2, mlat AS y2
      FROM ring_refs r JOIN nodes ON id = node WHERE r.way IN (SELECT way FROM firsts WHERE way % 5 = 0 AND n >= 3) WINDOW w AS (PARTITION BY r.way ORDER BY r.pos)) GROUP BY way""",
    way_segments="SELECT way, seq, y1, x1, y2, x2 FROM seg WHERE y1 IS NOT NULL",
    way_crossed_tiles="SELECT way, tile FROM crossed",
    way_tiles_exact="SELECT way, tile FROM exact",
    box_tiles="SELECT way, tile FROM boxed",
    closed_way_tiles="SELECT way, tile FROM boxed WHERE way IN (SELECT way FROM firsts WHERE way % 5 = 0 AND n >= 3)",
    relation_tiles="SELECT rel, tile FROM rt",
    overlapping_tiles=f"SELECT a.tile AS a, b.tile AS b {_PAIR} WHERE a.tile < b.tile AND a.min_lat < a.max_lat AND b.min_lat < b.max_lat AND {_OVER.format(a='a', b='b')}",
    touching_tiles="SELECT a.tile AS a, b.tile AS b FROM tiles a, tiles b WHERE a.tile < b.tile AND a.min_lat <= b.max_lat AND a.max_lat >= b.min_lat AND a.min_lon <= b.max_lon AND a.max_lon >= b.min_lon",
    distinct_area_map="""SELECT tiles, CAST(sum(size) AS BIGINT) AS size FROM (
      SELECT string_agg(tile, ',' ORDER BY tile) AS tiles, any_value((lat1 - lat0) * (lon1 - lon0)) AS size
      FROM (SELECT v AS lat0, lead(v) OVER (ORDER BY v) AS lat1 FROM (SELECT min_lat - tile % 3 * 500 AS v FROM tiles UNION SELECT max_lat FROM tiles)),
           (SELECT v AS lon0, lead(v) OVER (ORDER BY v) AS lon1 FROM (SELECT min_lon AS v FROM tiles UNION SELECT max_lon + tile % 2 * 700 FROM tiles)), tiles
      WHERE min_lat - tile % 3 * 500 <= lat0 AND lat1 <= max_lat AND min_lon <= lon0 AND lon1 <= max_lon + tile % 2 * 700 GROUP BY lat0, lon0) GROUP BY tiles""",
    city_in_tile="SELECT tile, id FROM city_tile",
    cities_by_latitude="SELECT id, country, name, lat, population FROM city",
    tile_names="SELECT tile, name FROM tiles LEFT JOIN best USING (tile)",
    map_ids="SELECT tile, map_id FROM numbered",
    areas_list_rows=f"SELECT {_MAP8} || ': ' || min_lat || ',' || min_lon || ' to ' || max_lat || ',' || max_lon AS line FROM numbered",
    areas_list_parsed="SELECT map_id, min_lat, min_lon, max_lat, max_lon FROM numbered",
    template_rows=f"""SELECT 'mapname: ' || {_MAP8} AS mapname, coalesce('description: ' || substr(name, 1, 50), '# description: OSM Map') AS description,
      'input-file: ' || {_MAP8} || '.osm.pbf' AS input_file FROM numbered LEFT JOIN best USING (tile)""",
    problem_ways="SELECT way FROM pw",
    problem_relations="SELECT rel FROM pr",
    single_area_relations="SELECT rel, tile FROM single",
    problem_ids_union="SELECT way AS id FROM pw UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0",
    problem_report="SELECT 'way: ' || way || ' #' AS line FROM pw UNION ALL SELECT 'rel: ' || rel || ' #' FROM pr",
    set_except="SELECT way, coalesce(string_agg(tile, ',' ORDER BY tile) FILTER (tile > low), '') AS rest, string_agg(tile, ',' ORDER BY tile) || ',99' AS more, count(*) AS n FROM (SELECT *, min(tile) OVER (PARTITION BY way) AS low FROM wt) GROUP BY way",
    needed_nodes_semi="SELECT DISTINCT node FROM refs WHERE way IN (SELECT way FROM pw)",
    missing_nodes_anti="SELECT o_orderkey AS way FROM orders WHERE o_orderkey NOT IN (SELECT way FROM refs)",
    merge_lookup="SELECT id, tile, mlat FROM nodes JOIN nt ON id = node",
    relation_closure="SELECT ancestor, descendant FROM closure",
    relation_loops="SELECT DISTINCT ancestor AS rel FROM closure WHERE ancestor = descendant",
    relation_parents="SELECT rel FROM pr UNION SELECT ancestor FROM closure WHERE descendant IN (SELECT rel FROM pr)",
    parent_tiles="SELECT rel, tile FROM rt UNION SELECT 10000000 + c_nationkey, tile FROM rt JOIN customer ON rel = c_custkey",
    member_propagation_ways="SELECT DISTINCT m.way, tile FROM way_members m JOIN rt USING (rel) WHERE m.way IN (SELECT way FROM wt)",
    member_propagation_nodes="SELECT node, tile FROM node_members JOIN rt USING (rel) UNION SELECT node, tile FROM refs JOIN wt USING (way)",
    relation_incomplete=_NO_NODES,
    relation_boxes="SELECT rel, min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM way_members JOIN wb USING (way) WHERE rel IN (SELECT rel FROM used WHERE area) GROUP BY rel",
    distribution_nodes="SELECT node, tile FROM nt UNION SELECT node, tile FROM nx",
    distribution_ways="SELECT way, tile FROM fw",
    distribution_relations="SELECT rel, tile FROM frel",
    distribution_plain="SELECT tile, kind, count(*) AS n FROM (SELECT tile, 'node' AS kind FROM ont UNION ALL SELECT tile, 'way' FROM owt UNION ALL SELECT tile, 'relation' FROM ort) GROUP BY tile, kind",
    event_windows="""SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""",
)
