"""Boxes and polygons as cells of a compressed grid; small inputs, on the driver.

Rectilinear areas are exact: the grid's lines are all edges that occur. General
polygons are rasterised to the cells of the density grid that they meet.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np

from ..functions.units import WORLD_LAT, WORLD_LON
from ..sources.texts import Ring, Tile

MAX_VERTICES = 40
MAX_SET, MAX_SETS = 10, 1000


def _lines(tiles: Iterable[Tile], *more: Tile) -> tuple[np.ndarray, np.ndarray]:
    every = [*tiles, *more]
    lat = np.unique([v for t in every for v in (t.min_lat, t.max_lat)])
    lon = np.unique([v for t in every for v in (t.min_lon, t.max_lon)])
    return lat, lon


def _cells(t: Tile, lat: np.ndarray, lon: np.ndarray) -> tuple[slice, slice]:
    return slice(*np.searchsorted(lat, (t.min_lat, t.max_lat))), slice(*np.searchsorted(lon, (t.min_lon, t.max_lon)))


def _rectangles(label: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(label, y0, y1, x0, x1): cells of equal label merged to maximal runs, then equal runs of neighbouring rows; -1 is nothing."""
    open_runs: dict[tuple[int, int, int], int] = {}
    out = []
    rows = label.shape[0]
    for y in range(rows + 1):
        runs = set()
        if y < rows:
            row = label[y]
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
            runs = {(int(row[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if row[a] >= 0}
        for key in [k for k in open_runs if k not in runs]:
            out.append((key[0], open_runs.pop(key), y, key[1], key[2]))
        for key in runs:
            open_runs.setdefault(key, y)
    return out


def distinct_areas(tiles: list[Tile]) -> list[tuple[Tile, tuple[int, ...]]]:
    """Disjoint areas with the numbers of the tiles that cover them.

    An area of one tile keeps its id; a common piece of several gets a negative one.
    """
    if not tiles:
        return []
    lat, lon = _lines(tiles)
    cover = np.zeros((len(lat) - 1, len(lon) - 1), dtype=object)
    cover[:] = [[()] * (len(lon) - 1) for _ in range(len(lat) - 1)]
    for i, t in enumerate(tiles):
        ys, xs = _cells(t, lat, lon)
        for y in range(ys.start, ys.stop):
            for x in range(xs.start, xs.stop):
                cover[y, x] = (*cover[y, x], i)
    sets = sorted({c for c in cover.ravel() if c})
    number = {c: k for k, c in enumerate(sets)}
    label = np.array([[number.get(c, -1) for c in row] for row in cover])
    out, negative = [], 0
    for k, y0, y1, x0, x1 in sorted(_rectangles(label)):
        own = sets[k]
        if len(own) == 1:
            map_id = tiles[own[0]].map_id
        else:
            negative -= 1
            map_id = negative
        out.append((Tile(map_id, int(lat[y0]), int(lon[x0]), int(lat[y1]), int(lon[x1])), own))
    return out


def pseudo_areas(tiles: list[Tile]) -> list[Tile]:
    """Rectangles that cover the rest of the planet, with negative ids; neighbours of equal extent are merged."""
    world = Tile(0, -WORLD_LAT, -WORLD_LON, WORLD_LAT, WORLD_LON)
    lat, lon = _lines(tiles, world)
    label = np.zeros((len(lat) - 1, len(lon) - 1), dtype=int)
    for t in tiles:
        label[_cells(t, lat, lon)] = -1
    return [Tile(-1 - i, int(lat[y0]), int(lon[x0]), int(lat[y1]), int(lon[x1])) for i, (_, y0, y1, x0, x1) in enumerate(_rectangles(label))]


def rectangle_unions(tiles: list[Tile]) -> list[tuple[int, ...]]:
    """Sets of disjoint tiles whose union is a rectangle: a way within such a set cannot leave it between its nodes.

    Two rectangles make one where they share a whole side, so sets are found by their sides.
    """
    found: dict[tuple[int, ...], tuple[int, int, int, int]] = {}
    after: dict[tuple, list[tuple[int, ...]]] = {}
    before: dict[tuple, list[tuple[int, ...]]] = {}

    def sides(b: tuple[int, int, int, int]) -> list[tuple[tuple, tuple]]:
        """For both axes: the lower side and the upper one."""
        lat0, lon0, lat1, lon1 = b
        return [(("lon", lat0, lat1, lon0), ("lon", lat0, lat1, lon1)), (("lat", lon0, lon1, lat0), ("lat", lon0, lon1, lat1))]

    def add(s: tuple[int, ...], b: tuple[int, int, int, int]) -> None:
        found[s] = b
        for low, high in sides(b):
            after.setdefault(low, []).append(s)
            before.setdefault(high, []).append(s)

    for i, t in enumerate(tiles):
        add((i,), (t.min_lat, t.min_lon, t.max_lat, t.max_lon))
    last = list(found)
    while last and len(found) - len(tiles) < MAX_SETS:
        bigger = {}
        for s in last:
            a = found[s]
            for low, high in sides(a):
                for o in after.get(high, []) + before.get(low, []):
                    b, u = found[o], tuple(sorted({*s, *o}))
                    if len(u) <= MAX_SET and u not in found:
                        bigger[u] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        for u, box in bigger.items():
            add(u, box)
        last = list(bigger)
    return sorted(s for s in found if len(s) > 1)


def outline(tiles: list[Tile]) -> list[Ring]:
    """Rings around the union of tiles, in map units (lon, lat); straight runs are one edge, holes are marked."""
    if not tiles:
        return []
    lat, lon = _lines(tiles)
    full = np.zeros((len(lat) + 1, len(lon) + 1), dtype=bool)  # a free border on all sides
    for t in tiles:
        ys, xs = _cells(t, lat, lon)
        full[ys.start + 1 : ys.stop + 1, xs.start + 1 : xs.stop + 1] = True
    # directed edges with the area on their left
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(a: tuple[int, int], b: tuple[int, int]) -> None:
        after.setdefault(a, []).append(b)

    for y in range(1, full.shape[0] - 1):
        for x in range(1, full.shape[1] - 1):
            if not full[y, x]:
                continue
            if not full[y - 1, x]:
                edge((y - 1, x - 1), (y - 1, x))
            if not full[y, x + 1]:
                edge((y - 1, x), (y, x))
            if not full[y + 1, x]:
                edge((y, x), (y, x - 1))
            if not full[y, x - 1]:
                edge((y, x - 1), (y - 1, x - 1))
    rings = []
    while after:
        start = min(after)
        at, path = start, []
        came = (0, 0)
        while True:
            path.append(at)
            options = after[at]
            # at a corner where two areas touch, turn left, which keeps them apart
            left = (came[1], -came[0])
            nxt = next((o for o in options if (o[0] - at[0], o[1] - at[1]) == left), options[0])
            options.remove(nxt)
            if not options:
                del after[at]
            came = (nxt[0] - at[0], nxt[1] - at[1])
            at = nxt
            if at == start:
                break
        corners = [p for a, p, b in zip([path[-1], *path[:-1]], path, [*path[1:], path[0]]) if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
        points = [(float(lon[x]), float(lat[y])) for y, x in corners]
        points.append(points[0])
        area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:]))
        rings.append(Ring(points, hole=area < 0))
    return sorted(rings, key=lambda r: r.hole)


def too_complex(rings: list[Ring], shift: int) -> bool:
    """A ring's slanting edges would become more than ``MAX_VERTICES`` corners on the grid."""
    def corners(r: Ring) -> int:
        return sum(2 * int(min(abs(x1 - x2), abs(y1 - y2)) // (1 << shift)) for (x1, y1), (x2, y2) in zip(r.points, r.points[1:]))

    return any(corners(r) > MAX_VERTICES for r in rings)


def _clipped(points: list[tuple[float, float]], t: Tile) -> list[tuple[float, float]]:
    """The ring's part within the tile's box, one half plane after the other."""
    points = points[:-1]
    for axis, bound, sign in ((0, t.min_lon, 1), (0, t.max_lon, -1), (1, t.min_lat, 1), (1, t.max_lat, -1)):
        out = []
        for a, b in zip([*points[-1:], *points[:-1]], points):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da * db < 0:
                k = da / (da - db)
                out.append((a[0] + k * (b[0] - a[0]), a[1] + k * (b[1] - a[1])))
            if db >= 0:
                out.append(b)
        points = out
    return points


def _size(points: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, [*points[1:], *points[:1]]))) / 2


def cut_to(rings: list[Ring], t: Tile) -> Tile:
    """The tile, cut to the polygon where what is left is a rectangle; else the whole tile."""
    parts = [(_clipped(r.points, t), r.hole) for r in rings]
    corners = [p for part, hole in parts if not hole and _size(part) for p in part]
    if not corners or any(hole and _size(part) for part, hole in parts):
        return t
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*corners))
    covered = sum(_size(part) for part, _ in parts)
    if abs(covered - (x1 - x0) * (y1 - y0)) > 1e-6 * covered:
        return t
    return replace(t, min_lat=round(y0), min_lon=round(x0), max_lat=round(y1), max_lon=round(x1))


def _inside(rings: list[Ring], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule, holes included."""
    odd = np.zeros(np.broadcast(x, y).shape, dtype=bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r.points, r.points[1:]):
            if y1 != y2:
                span = (y1 > y) != (y2 > y)
                odd ^= span & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def rasterise(rings: list[Ring], min_lat: int, min_lon: int, width: int, height: int, shift: int) -> np.ndarray:
    """Cells [x, y] that have any point in common with the polygon (map units)."""
    size = 1 << shift
    xs, ys = min_lon + np.arange(width) * size, min_lat + np.arange(height) * size
    hit = _inside(rings, xs[:, None] + size / 2, ys[None, :] + size / 2)
    # a cell whose centre is outside still counts if an edge meets it
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r.points, r.points[1:]):
            i0, i1 = sorted((int((x1 - min_lon) // size), int((x2 - min_lon) // size)))
            for i in range(max(i0, 0), min(i1, width - 1) + 1):
                lo, hi = max(min(x1, x2), xs[i]), min(max(x1, x2), xs[i] + size)
                if x1 == x2:
                    a, b = sorted((y1, y2))
                else:
                    a, b = sorted((y1 + (y2 - y1) * (v - x1) / (x2 - x1) for v in (lo, hi)))
                j0, j1 = int((a - min_lat) // size), int((b - min_lat) // size)
                hit[i, max(j0, 0) : max(min(j1, height - 1) + 1, 0)] = True
    return hit


def meets(rings: list[Ring], t: Tile) -> bool:
    """The polygon and the tile's box have a point in common."""
    w, h = t.max_lon - t.min_lon, t.max_lat - t.min_lat
    corners = _inside(rings, np.array([t.min_lon, t.max_lon, t.min_lon, t.max_lon]), np.array([t.min_lat, t.min_lat, t.max_lat, t.max_lat]))
    if corners.any() or any(t.min_lon <= x <= t.max_lon and t.min_lat <= y <= t.max_lat for r in rings for x, y in r.points):
        return True
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r.points, r.points[1:]):
            if min(x1, x2) > t.max_lon or max(x1, x2) < t.min_lon or min(y1, y2) > t.max_lat or max(y1, y2) < t.min_lat:
                continue
            side = [(x2 - x1) * (b - y1) - (y2 - y1) * (a - x1) for a in (t.min_lon, t.min_lon + w) for b in (t.min_lat, t.min_lat + h)]
            if min(side) <= 0 <= max(side):
                return True
    return False
