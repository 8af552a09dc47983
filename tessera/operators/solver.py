"""Tile search on the driver: rectangles of grid cells with a bounded number of nodes.

The input is the density grid, already aggregated by Spark: a few million cells
at most, whatever the number of nodes. All sums come from a 2-D prefix table,
so a candidate cut costs a constant number of look-ups.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

#: Shape limits of the search.
NICE_RATIO = 4.0
WORST_RATIO = 32.0
#: Degrees of a tile that is accepted by size, below a node budget of ``LARGE_BUDGET``.
MAX_LAT_DEGREES, MAX_LON_DEGREES = 85.0, 90.0
LARGE_BUDGET = 10_000_000
GOOD_FILL = 0.93
ROUNDS = 100
#: Corners of a polygon's part that is still cut at them; a more complex one is split as its box.
MAX_CORNERS = 40
#: Dense tables of the grid may take so many bytes on the driver.
MAX_GRID_BYTES = 4 << 30
#: Empty bands: longer than this many degrees, or than this many cells with many nodes on both sides.
BAND_DEGREES, BAND_CELLS = 30.0, 10


class SplitFailed(RuntimeError):
    """No set of tiles meets the limits."""


@dataclass(frozen=True)
class Rect:
    """Cells x0 <= x < x1, y0 <= y < y1."""

    x0: int
    y0: int
    x1: int
    y1: int

    @property
    def width(self) -> int:
        return self.x1 - self.x0

    @property
    def height(self) -> int:
        return self.y1 - self.y0

    @property
    def cells(self) -> int:
        return self.width * self.height


class Grid:
    """Counts with prefix sums; ``row0`` is the latitude of the first row in cells from the equator."""

    def __init__(self, counts: np.ndarray, shift: int, row0: int = 0, inside: np.ndarray | None = None):
        self.counts = counts  # [x, y]
        self.shift = shift
        self.row0 = row0
        self.inside = inside
        self.sum = np.zeros((counts.shape[0] + 1, counts.shape[1] + 1), dtype=np.int64)
        self.sum[1:, 1:] = counts.cumsum(0).cumsum(1)
        self.out = None
        if inside is not None:
            self.out = np.zeros_like(self.sum)
            self.out[1:, 1:] = (~inside).cumsum(0).cumsum(1)
        degree = 360.0 * (1 << shift) / (1 << 24)
        edges = np.radians((row0 + np.arange(counts.shape[1] + 1)) * degree)
        self.cos = np.cos(edges)
        self.degree = degree

    @classmethod
    def from_cells(cls, cells: DataFrame, shift: int, width: int, height: int, row0: int = 0) -> Grid:
        """From a sparse (x, y, n) table."""
        if 24 * width * height > MAX_GRID_BYTES:
            raise ValueError(f"a grid of {width} x {height} cells is too large for the search; choose a lower resolution")
        counts = np.zeros((width, height), dtype=np.int64)
        pdf = cells.select("x", "y", "n").toPandas()
        counts[pdf["x"].to_numpy(), pdf["y"].to_numpy()] = pdf["n"].to_numpy()
        return cls(counts, shift, row0)

    def whole(self) -> Rect:
        return Rect(0, 0, *self.counts.shape)

    def _of(self, table: np.ndarray, r: Rect) -> int:
        return int(table[r.x1, r.y1] - table[r.x0, r.y1] - table[r.x1, r.y0] + table[r.x0, r.y0])

    def count(self, r: Rect) -> int:
        return self._of(self.sum, r)

    def outside(self, r: Rect) -> float:
        """Share of the cells that lie outside the polygon."""
        return self._of(self.out, r) / r.cells if self.out is not None else 0.0

    def columns(self, r: Rect) -> np.ndarray:
        """Running node counts over the columns of a rectangle."""
        return self.sum[r.x0 : r.x1 + 1, r.y1] - self.sum[r.x0 : r.x1 + 1, r.y0] - (self.sum[r.x0, r.y1] - self.sum[r.x0, r.y0])

    def rows(self, r: Rect) -> np.ndarray:
        return self.sum[r.x1, r.y0 : r.y1 + 1] - self.sum[r.x0, r.y0 : r.y1 + 1] - (self.sum[r.x1, r.y0] - self.sum[r.x0, r.y0])

    def ratio(self, r: Rect) -> float:
        """Width to height on the ground, by the widest parallel of the tile."""
        lo, hi = self.row0 + r.y0, self.row0 + r.y1
        wide = 1.0 if lo <= 0 <= hi else max(self.cos[r.y0], self.cos[r.y1])
        return r.width * wide / r.height

    def shape(self, r: Rect) -> float:
        """The ratio, turned to 1 or more."""
        x = self.ratio(r)
        return x if x >= 1 else 1 / x if x else float("inf")

    def small_enough(self, r: Rect) -> bool:
        return r.height * self.degree <= MAX_LAT_DEGREES and r.width * self.degree <= MAX_LON_DEGREES

    def trim(self, r: Rect) -> Rect:
        """Without empty outer columns and rows."""
        c, w = np.diff(self.columns(r)), np.diff(self.rows(r))
        if not c.any():
            return r
        xs, ys = np.flatnonzero(c), np.flatnonzero(w)
        return Rect(r.x0 + int(xs[0]), r.y0 + int(ys[0]), r.x0 + int(xs[-1]) + 1, r.y0 + int(ys[-1]) + 1)


@dataclass
class Solution:
    tiles: list[Rect] = field(default_factory=list)
    worst_ratio: float = 0.0
    worst_count: int = 1 << 62

    def add(self, grid: Grid, r: Rect) -> Solution:
        return Solution([*self.tiles, r], max(self.worst_ratio, grid.shape(r)), min(self.worst_count, grid.count(r)))

    def merged(self, other: Solution) -> Solution:
        return Solution(self.tiles + other.tiles, max(self.worst_ratio, other.worst_ratio), min(self.worst_count, other.worst_count))

    def nice(self, budget: int) -> bool:
        return bool(self.tiles) and (len(self.tiles) == 1 or self.worst_ratio <= NICE_RATIO and self.worst_count >= budget // 3)

    def better_than(self, other: Solution, budget: int) -> bool:
        if not self.tiles or not other.tiles:
            return bool(self.tiles)
        if self.nice(budget) != other.nice(budget):
            return self.nice(budget)
        n, m = len(self.tiles), len(other.tiles)
        near = abs(n - m) < 0.01 * max(n, m)
        if near and max(self.worst_ratio, other.worst_ratio) > 1.5 * min(self.worst_ratio, other.worst_ratio):
            return self.worst_ratio < other.worst_ratio
        if self.worst_count != other.worst_count and max(self.worst_count, other.worst_count) > 1000:
            return self.worst_count > other.worst_count
        return (n, self.worst_ratio) < (m, other.worst_ratio)


class Search:
    """One search with fixed limits; results of partial searches are kept."""

    def __init__(self, grid: Grid, budget: int, least: int, worst: float, limit: int, exhaustive: bool, allow_empty: bool, any_size: bool = False):
        self.grid, self.budget, self.least, self.worst = grid, budget, least, worst
        self.limit, self.exhaustive, self.allow_empty = limit, exhaustive, allow_empty
        self.any_size = any_size or budget >= LARGE_BUDGET
        self.failures = 0
        self.known: dict[Rect, Solution | None] = {}

    def find(self, r: Rect, depth: int = 0) -> Solution | None:
        g = self.grid
        n = g.count(r)
        if n == 0:
            return Solution() if self.allow_empty and r.cells > 4 else None
        if n > self.budget and r.cells == 1:
            return Solution().add(g, r)
        if n < self.least:
            return Solution().add(g, r) if depth == 0 else None
        if g.out is not None and g.outside(r) == 1.0:
            return Solution()
        if n <= self.budget and g.shape(r) < self.worst and (self.any_size or g.small_enough(r)):
            return Solution().add(g, r) if g.outside(r) <= 0.5 else None
        if n < 2 * self.least or r.cells == 1:
            return None
        if r in self.known:
            return self.known[r]
        result = None
        axes = "xy" if g.ratio(r) >= 1 else "yx"
        for axis in axes:
            for a, b in self.cuts(r, axis):
                if self.failures >= self.limit:
                    break
                first, second = sorted((a, b), key=g.count)
                s1 = self.find(first, depth + 1)
                s2 = self.find(second, depth + 1) if s1 is not None else None
                if s1 is not None and s2 is not None:
                    result = s1.merged(s2)
                    break
                self.failures += 1
            if result is not None:
                break
        self.known[r] = result
        return result

    def cuts(self, r: Rect, axis: str) -> Iterator[tuple[Rect, Rect]]:
        """Pairs of parts that both hold the least number of nodes, from the most even cut outwards."""
        g = self.grid
        run = g.columns(r) if axis == "x" else g.rows(r)
        total = int(run[-1])
        need = 0 if self.allow_empty else self.least
        first = max(1, int(np.searchsorted(run, need)))
        last = min(len(run) - 2, int(np.searchsorted(run, total - need, side="right")) - 1)
        if first > last:
            return
        middle = min(max(int(np.searchsorted(run, total / 2)), first), last)
        if self.exhaustive or last - first < 8:
            picks = sorted(range(first, last + 1), key=lambda i: abs(i - middle))
        else:
            full = min(max(int(np.searchsorted(run, self.budget, side="right")) - 1, first), last)
            rest = min(max(int(np.searchsorted(run, total - self.budget)), first), last)
            even = np.linspace(first, last, 7 if total > 4 * self.budget else 20).astype(int)
            picks = dict.fromkeys([middle, full, rest, first, last, *sorted(even.tolist(), key=lambda i: abs(i - middle))])
        for i in picks:
            if axis == "x":
                yield Rect(r.x0, r.y0, r.x0 + i, r.y1), Rect(r.x0 + i, r.y0, r.x1, r.y1)
            else:
                yield Rect(r.x0, r.y0, r.x1, r.y0 + i), Rect(r.x0, r.y0 + i, r.x1, r.y1)


def without_bands(grid: Grid, r: Rect, budget: int, axis: str = "x", tried: bool = False) -> list[Rect]:
    """Pieces between large empty bands, axes in turn; pieces without nodes go."""
    run = np.diff(grid.columns(r) if axis == "x" else grid.rows(r))
    filled = np.flatnonzero(run)
    if not len(filled):
        return []
    pieces, start, before = [], int(filled[0]), 0
    total = int(run.sum())
    for a, b in zip(filled[:-1], filled[1:]):
        before += int(run[a])
        gap = int(b - a - 1)
        after = total - int(run[: a + 1].sum())
        if gap * grid.degree > BAND_DEGREES or gap > BAND_CELLS and before > budget / 3 and after > budget / 3:
            pieces.append((start, int(a) + 1))
            start, before = int(b), 0
    pieces.append((start, int(filled[-1]) + 1))
    cut = [Rect(r.x0 + s, r.y0, r.x0 + e, r.y1) if axis == "x" else Rect(r.x0, r.y0 + s, r.x1, r.y0 + e) for s, e in pieces]
    other = "y" if axis == "x" else "x"
    if len(cut) == 1:
        return cut if tried else without_bands(grid, cut[0], budget, other, True)
    return [x for c in cut for x in without_bands(grid, c, budget, other, False)]


def solve(grid: Grid, r: Rect, budget: int, limit: int = 200_000, allow_empty: bool = False) -> Solution:
    """Best solution of one rectangle: limits are tightened after a success and relaxed after a failure."""
    total = grid.count(r)
    least = max(1, min(budget // 20, total))
    worst = WORST_RATIO if total / budget < 4 else max(NICE_RATIO, grid.shape(r))
    exhaustive = total < 300 * budget and (grid.small_enough(r) or total < 10 * budget)
    best = Solution()
    state: set = set()
    any_size = False
    for _ in range(ROUNDS):
        key = (least, round(worst, 6), exhaustive, limit, any_size)
        if key in state:
            break
        state.add(key)
        found = Search(grid, budget, least, worst, min(limit, 20_000 if best.tiles else limit), exhaustive, allow_empty, any_size).find(r)
        if found is not None and found.better_than(best, budget):
            factor = 1.10 if not best.tiles or not best.nice(budget) else min(1.30, found.worst_count / max(1, best.worst_count))
            best = found
            if len(best.tiles) <= 1 or total / len(best.tiles) / budget > GOOD_FILL:
                break
            least = min(budget, max(budget // 3, int(best.worst_count * factor)))
            worst = min(max(best.worst_ratio / 2, NICE_RATIO), WORST_RATIO)
        elif best.tiles:
            step = (least - best.worst_count) // 2
            if step <= 0:
                break
            least -= step
        elif least > 1:
            least = least // 2
        elif worst < 1e9:
            worst = 1e9
        elif not any_size:
            any_size = True
        elif exhaustive:
            break
        else:
            exhaustive = True
    return best


def trimmed(grid: Grid, s: Solution) -> list[Rect]:
    """Tiles on the outer border of the solution lose their own empty rows and columns on that side; inner sides stay."""
    tiles = [t for t in s.tiles if grid.count(t)]
    if not tiles:
        return []
    box = Rect(min(t.x0 for t in tiles), min(t.y0 for t in tiles), max(t.x1 for t in tiles), max(t.y1 for t in tiles))
    out = []
    for t in tiles:
        inner = grid.trim(t)
        out.append(Rect(
            inner.x0 if t.x0 == box.x0 else t.x0, inner.y0 if t.y0 == box.y0 else t.y0,
            inner.x1 if t.x1 == box.x1 else t.x1, inner.y1 if t.y1 == box.y1 else t.y1,
        ))
    return out


def split(grid: Grid, budget: int, limit: int = 200_000, trim: bool = True) -> list[Rect]:
    """Tiles that cover all nodes, each with at most ``budget`` of them or a single cell."""
    out: list[Rect] = []
    for part in without_bands(grid, grid.trim(grid.whole()) if trim else grid.whole(), budget) if trim else [grid.whole()]:
        best = solve(grid, part, budget, limit)
        if not best.tiles:
            best = solve(grid, part, budget, limit, allow_empty=True)
        if not best.tiles:
            raise SplitFailed(f"no solution for {part}")
        out += trimmed(grid, best) if trim else [t for t in best.tiles if grid.count(t)]
    return sorted(out, key=lambda t: (t.x0, t.y0))


def split_to(grid: Grid, wanted: int, limit: int = 200_000, trim: bool = True) -> list[Rect]:
    """As many tiles as wanted, or as near as the bisection of the budget comes."""
    total = grid.count(grid.whole())
    low, high = 1, max(2, total)
    best: list[Rect] = []
    while low <= high:
        budget = (low + high) // 2
        try:
            tiles = split(grid, budget, limit, trim)
        except SplitFailed:
            low = budget + 1
            continue
        if not best or abs(len(tiles) - wanted) < abs(len(best) - wanted):
            best = tiles
        if len(tiles) == wanted:
            break
        if len(tiles) > wanted:
            low = budget + 1
        else:
            high = budget - 1
    return best


def _pieces(mask: np.ndarray) -> list[np.ndarray]:
    """Parts of a mask whose cells are joined by edges."""
    label = np.zeros(mask.shape, dtype=np.int64)
    label[mask] = np.arange(1, mask.sum() + 1)
    while True:
        spread = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(label, step, axis)
                edge = [slice(None), slice(None)]
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                spread = np.maximum(spread, moved)
        spread[~mask] = 0
        # jump to the label of the cell that the label names, so that long parts need few rounds
        flat = spread.ravel()
        names = np.concatenate([[0], flat[np.flatnonzero(mask.ravel())]])
        spread = names[spread]
        if (spread == label).all():
            return [label == k for k in np.unique(label[mask])]
        label = spread


def _box_of(mask: np.ndarray, within: Rect) -> Rect | None:
    part = mask[within.x0 : within.x1, within.y0 : within.y1]
    if not part.any():
        return None
    xs, ys = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
    return Rect(within.x0 + int(xs[0]), within.y0 + int(ys[0]), within.x0 + int(xs[-1]) + 1, within.y0 + int(ys[-1]) + 1)


def _corners(mask: np.ndarray, r: Rect) -> list[tuple[int, int]]:
    """Grid points where the outline of the part of the mask within ``r`` turns."""
    part = np.pad(mask[r.x0 : r.x1, r.y0 : r.y1], 1).astype(int)
    around = part[:-1, :-1] + part[1:, :-1] + part[:-1, 1:] + part[1:, 1:]
    slanted = (around == 2) & (part[:-1, :-1] == part[1:, 1:])
    return [(r.x0 + int(x), r.y0 + int(y)) for x, y in np.argwhere((around == 1) | (around == 3) | slanted)]


def _rectangular(grid: Grid, r: Rect, budget: int, limit: int) -> Solution:
    best = solve(grid, r, budget, limit)
    return best if best.tiles else solve(grid, r, budget, limit, allow_empty=True)


def _within(grid: Grid, mask: np.ndarray, r: Rect, budget: int, limit: int, known: dict[Rect, Solution]) -> Solution:
    """Tiles of the part of the mask within ``r``: cut at its corners until the parts are rectangles."""
    if r in known:
        return known[r]
    corners = _corners(mask, r)
    if mask[r.x0 : r.x1, r.y0 : r.y1].all():
        known[r] = _rectangular(grid, r, budget, limit) if grid.count(r) else Solution()
        return known[r]
    if len(corners) > MAX_CORNERS:
        warnings.warn("the polygon is too complex, its box is split instead", stacklevel=2)
        known[r] = _rectangular(grid, r, budget, limit)
        return known[r]
    known[r] = Solution()
    for x, y in corners:
        cuts = []
        if r.x0 < x < r.x1:
            cuts.append((Rect(r.x0, r.y0, x, r.y1), Rect(x, r.y0, r.x1, r.y1)))
        if r.y0 < y < r.y1:
            cuts.append((Rect(r.x0, r.y0, r.x1, y), Rect(r.x0, y, r.x1, r.y1)))
        for halves in cuts:
            found = Solution()
            for half in sorted(halves, key=lambda h: h.cells):
                box = _box_of(mask, half)
                if box is None or not grid.count(box):
                    continue
                part = _within(grid, mask, box, budget, limit, known)
                if not part.tiles:
                    break
                found = found.merged(part)
            else:
                if found.tiles:
                    known[r] = found
                    return found
    return known[r]


def split_polygon(grid: Grid, budget: int, limit: int = 200_000) -> list[Rect]:
    """As ``split`` within ``grid.inside``, piece by piece: cells outside the polygon do not count.

    A piece is cut at its corners into rectangles, each split on its own. Where that
    finds nothing, its box is split into tiles that are at most half outside.
    """
    out: list[Rect] = []
    for mask in _pieces(grid.inside):
        own = Grid(np.where(mask, grid.counts, 0), grid.shift, grid.row0)
        box = _box_of(mask, own.whole())
        if not own.count(box):
            continue
        best = _within(own, mask, box, budget, limit, {})
        if not best.tiles:
            own = Grid(own.counts, grid.shift, grid.row0, mask)
            best = solve(own, own.trim(box), budget, limit, allow_empty=True)
        if not best.tiles:
            own.out = None  # a thin polygon: the half-outside rule leaves nothing
            best = solve(own, own.trim(box), budget, limit, allow_empty=True)
        if not best.tiles:
            raise SplitFailed("no solution within the polygon")
        out += [t for t in best.tiles if own.count(t)]
    return sorted(out, key=lambda t: (t.x0, t.y0))
