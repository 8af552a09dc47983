"""Invariants of the tile search and of the cell algebra."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import polygons as P
from tessera.operators import solver as S
from tessera.sources.texts import Ring, Tile


def grid(seed, w=80, h=60, groups=6):
    rng = np.random.default_rng(seed)
    c = np.zeros((w, h), dtype=int)
    for _ in range(groups):
        x, y, s = rng.integers(0, w), rng.integers(0, h), rng.integers(2, 15)
        p = (rng.normal(0, s, (3000, 2)) + [x, y]).astype(int)
        p = p[(p[:, 0] >= 0) & (p[:, 0] < w) & (p[:, 1] >= 0) & (p[:, 1] < h)]
        np.add.at(c, (p[:, 0], p[:, 1]), 1)
    return S.Grid(c, 11)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("budget", [400, 2500])
def test_tiles_cover_all_nodes_once(seed, budget):
    g = grid(seed)
    tiles = S.split(g, budget)
    cover = np.zeros_like(g.counts)
    for t in tiles:
        cover[t.x0 : t.x1, t.y0 : t.y1] += 1
        assert g.count(t) <= budget or t.cells == 1
        assert g.count(t) == g.counts[t.x0 : t.x1, t.y0 : t.y1].sum() > 0
    assert cover.max() == 1 and g.counts[cover == 0].sum() == 0


def test_no_trim_keeps_the_whole_grid():
    g = grid(1)
    cover = np.zeros_like(g.counts)
    for t in S.split(g, 2500, trim=False):
        cover[t.x0 : t.x1, t.y0 : t.y1] += 1
    assert cover.max() == 1


def test_wanted_number():
    assert abs(len(S.split_to(grid(2), 8)) - 8) <= 1


def test_empty_bands_are_cut_out():
    c = np.zeros((400, 20), dtype=int)
    c[:20] = c[-20:] = 10
    g = S.Grid(c, 14)
    assert [(r.x0, r.x1) for r in S.without_bands(g, g.whole(), 1000)] == [(0, 20), (380, 400)]


def test_polygon_split():
    g = grid(3)
    inside = np.zeros_like(g.counts, dtype=bool)
    inside[10:60, 10:40] = True
    tiles = S.split_polygon(S.Grid(g.counts, 11, 0, inside), 1500)
    own = np.where(inside, g.counts, 0)
    assert sum(int(own[t.x0 : t.x1, t.y0 : t.y1].sum()) for t in tiles) == own.sum()


def test_empty_grid():
    assert S.split(S.Grid(np.zeros((5, 5), dtype=int), 11), 100) == []


boxes = st.builds(lambda i, a, b, h, w: Tile(i, a * 10, b * 10, a * 10 + h * 10, b * 10 + w * 10), st.integers(1, 9), st.integers(-5, 5), st.integers(-5, 5), st.integers(1, 5), st.integers(1, 5))


@settings(max_examples=60, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=6))
def test_distinct_areas_have_the_same_cover(tiles):
    areas = P.distinct_areas(tiles)
    for lat in range(-55, 110, 10):
        for lon in range(-55, 110, 10):
            cover = tuple(i for i, t in enumerate(tiles) if t.min_lat < lat < t.max_lat and t.min_lon < lon < t.max_lon)
            hit = [own for a, own in areas if a.min_lat < lat < a.max_lat and a.min_lon < lon < a.max_lon]
            assert hit == ([cover] if cover else [])


@settings(max_examples=40, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=5))
def test_pseudo_areas_are_the_rest(tiles):
    rest = P.pseudo_areas(tiles)
    assert all(a.map_id < 0 for a in rest)
    for lat in [-4000000, *range(-55, 110, 10), 4000000]:
        for lon in [-8000000, *range(-55, 110, 10), 8000000]:
            real = any(t.min_lat < lat < t.max_lat and t.min_lon < lon < t.max_lon for t in tiles)
            assert real + sum(a.min_lat < lat < a.max_lat and a.min_lon < lon < a.max_lon for a in rest) == 1 or real


@settings(max_examples=40, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=5))
def test_outline_has_the_area_of_the_union(tiles):
    area = sum((x1 * y2 - x2 * y1) / 2 for r in P.outline(tiles) for (x1, y1), (x2, y2) in zip(r.points, r.points[1:]))
    assert area == sum((a.max_lat - a.min_lat) * (a.max_lon - a.min_lon) for a, _ in P.distinct_areas(tiles))


def test_outline_hole():
    ring = [Tile(1, 0, 0, 10, 30), Tile(2, 20, 0, 30, 30), Tile(3, 10, 0, 20, 10), Tile(4, 10, 20, 20, 30)]
    assert [r.hole for r in P.outline(ring)] == [False, True]


def test_rectangle_unions():
    t = [Tile(i, 0, i * 10, 10, i * 10 + 10) for i in range(3)]
    assert P.rectangle_unions(t) == [(0, 1), (0, 1, 2), (1, 2)]


def test_rasterise_and_meets():
    r = [Ring([(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 0.0)])]
    hit = P.rasterise(r, 0, 0, 8, 8, 3)
    assert hit[0, 0] and hit[4, 4] and hit[4, 0] and not hit[0, 4]
    assert P.meets(r, Tile(1, 0, 0, 5, 5)) and not P.meets(r, Tile(1, 30, 0, 39, 9))


def test_polygon_is_cut_at_its_corners():
    """An L and a separate square: tiles cover exactly the cells with nodes within, none lies outside."""
    inside = np.zeros((40, 40), dtype=bool)
    inside[2:30, 2:12] = inside[2:12, 2:30] = inside[32:38, 32:38] = True
    assert [int(m.sum()) for m in sorted(S._pieces(inside), key=lambda m: m.sum())] == [36, 460]
    assert len(S._corners(inside, S.Rect(2, 2, 30, 30))) == 6
    grid = S.Grid(np.full((40, 40), 50), 11, 0, inside)
    tiles = S.split_polygon(grid, 5000)
    cover = np.zeros((40, 40), dtype=int)
    for t in tiles:
        cover[t.x0 : t.x1, t.y0 : t.y1] += 1
    assert (cover == inside).all() and all(t.cells * 50 <= 5000 for t in tiles)


def test_pieces_of_random_masks():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 9)) < 0.55
        label, n = np.zeros(mask.shape, int), 0
        for cell in map(tuple, np.argwhere(mask)):
            if label[cell]:
                continue
            n, stack = n + 1, [cell]
            while stack:
                x, y = stack.pop()
                if 0 <= x < 12 and 0 <= y < 9 and mask[x, y] and not label[x, y]:
                    label[x, y] = n
                    stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        assert sorted(p.tobytes() for p in S._pieces(mask)) == sorted((label == k).tobytes() for k in range(1, n + 1))


def test_tiles_end_at_the_polygon():
    ring = [Ring([(15.0, 5.0), (95.0, 5.0), (95.0, 95.0), (15.0, 95.0), (15.0, 5.0)])]
    cut = P.cut_to(ring, Tile(1, 0, 0, 50, 50))
    assert (cut.min_lat, cut.min_lon, cut.max_lat, cut.max_lon) == (5, 15, 50, 50)
    slanted = [Ring([(0.0, 0.0), (50.0, 0.0), (0.0, 50.0), (0.0, 0.0)])]
    assert P.cut_to(slanted, Tile(1, 0, 0, 50, 50)) == Tile(1, 0, 0, 50, 50)
    hole = [*ring, Ring([(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 20.0)], hole=True)]
    assert P.cut_to(hole, Tile(1, 0, 0, 50, 50)) == Tile(1, 0, 0, 50, 50)
    assert P.cut_to(ring, Tile(1, 0, 100, 50, 150)) == Tile(1, 0, 100, 50, 150)


def test_complex_polygons():
    assert P.too_complex([Ring([(0.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)])], 2)
    assert not P.too_complex([Ring([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 0.0)])], 3)


def test_large_grids_are_refused():
    with pytest.raises(ValueError):
        S.Grid.from_cells(None, 0, 1 << 16, 1 << 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=4), st.lists(st.integers(1, 3), min_size=1, max_size=3))
def test_rectangle_unions_are_all_rectangles_of_a_grid(heights, widths):
    ys, xs = np.concatenate([[0], np.cumsum(heights)]), np.concatenate([[0], np.cumsum(widths)])
    tiles = [Tile(1, int(ys[i]), int(xs[j]), int(ys[i + 1]), int(xs[j + 1])) for i in range(len(heights)) for j in range(len(widths))]
    w = len(widths)
    want = [tuple(i * w + j for i in range(a, b) for j in range(c, d)) for a in range(len(heights)) for b in range(a + 1, len(heights) + 1) for c in range(w) for d in range(c + 1, w + 1)]
    assert P.rectangle_unions(tiles) == sorted(s for s in want if 2 <= len(s) <= P.MAX_SET)
