"""Sums over the discs of one block of centres, without a row per pair.

Anchors are sorted by strip and, within a strip, by x. In every strip a disc cuts
one stretch of anchors that surely meet it, whose sums are a difference of running
totals, and two short ends, whose features are tested one by one. The strips are as
high as the density asks for, so the work of a centre grows with the square root of
the features under its disc.

Where centres are dense, those of a small cell share that work. Features that meet
all or none of their discs are told from the middle of the cell. The others lie in a
band around the edge of the disc; they are sorted by direction and by distance from
the middle. How far a feature is from a centre follows from both, up to the width of
a sector, so each centre finds its sums in running totals as well and tests the few
features between the bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MARGIN = 1e-9  # of the radius: no rounding moves a feature into the sure stretch or out of the tested one
_QUERIES = 200_000  # (centre, strip) at once
_TESTS = 400_000  # features tested at once
# Nanoseconds, measured: a feature seen by a cell, its band's sorting included; a sector looked up; a
# feature tested for a centre; an edge of a feature in either; a cell as such.
_SEEN, _LOOKED, _TESTED, _EDGE, _CELL = 120.0, 120.0, 60.0, 60.0, 1e6


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype("float64", copy=False)


def _expand(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the stretches, and the number of the stretch each is from."""
    of = np.repeat(np.arange(len(length)), length)
    before = np.cumsum(length) - length
    return np.arange(len(of)) + (start - before)[of], of


def _sliced(lengths: np.ndarray, limit: int):
    """Slices of consecutive items whose lengths add up to about ``limit`` (a longer item is alone)."""
    total = np.cumsum(lengths)
    low = 0
    while low < len(lengths):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + limit, "right")))
        yield low, high
        low = high


def _way_to_segment(px, py, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / np.where(square == 0, 1.0, square)
    t = np.clip(np.where(square == 0, 0.0, t), 0.0, 1.0)
    return x1 + t * dx - px, y1 + t * dy - py


def _segment_hits(px, py, x1, y1, x2, y2, r: float) -> np.ndarray:
    ex, ey = _way_to_segment(px, py, x1, y1, x2, y2)
    return ex * ex + ey * ey <= r * r


def _odd(px, py, x1, y1, x2, y2, first: np.ndarray) -> np.ndarray:
    """Even-odd rule over the edges of each feature, which begin at ``first``."""
    rise = np.where(y2 == y1, 1.0, y2 - y1)
    crosses = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / rise)
    return np.add.reduceat(crosses.astype("int64"), first) % 2 == 1


class Shapes:
    """The exact test of one kind of geometry, for pairs of a position and a feature."""

    def __init__(self, table: pa.Table, kind: str):
        self.kind = kind
        if kind == "points":
            self.x, self.y = _column(table, "_ax"), _column(table, "_ay")
            self.half = np.zeros(len(self.x))
        elif kind == "segments":
            self.ends = [_column(table, c) for c in ("x1", "y1", "x2", "y2")]
            x1, y1, x2, y2 = self.ends
            self.x, self.y, self.half = (x1 + x2) / 2, (y1 + y2) / 2, np.hypot(x2 - x1, y2 - y1) / 2
        else:
            self.x, self.y, self.half = (_column(table, c) for c in ("_ax", "_ay", "_half"))
            lists = table.column("_edges").combine_chunks()
            self.count = lists.value_lengths().to_numpy().astype("int64")
            self.start = np.cumsum(self.count) - self.count
            flat = lists.flatten()
            self.ends = [_column(pa.table({c: flat.field(c)}), c) for c in ("x1", "y1", "x2", "y2")]

        self.edges, self.whole = float(kind == "segments"), np.ones(len(self.x), bool)
        if kind not in ("points", "segments"):  # whole: every vertex is known
            self.edges, some = float(self.count.mean()), self.count > 0
            self.whole[:] = False
            if some.any():
                self.whole[some] = np.logical_and.reduceat(np.isfinite(sum(self.ends)), self.start[some])

    def nearest(self, qx: float, qy: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How far whole features at ``at`` are from one place, the way from it to their nearest points, and by how much
        they come closer than those along that way (never, if they are convex)."""
        dx, dy, closer = self.x[at] - qx, self.y[at] - qy, np.zeros(len(at))
        if self.kind == "segments":
            dx, dy = _way_to_segment(qx, qy, *[e[at] for e in self.ends])
        elif self.kind != "points":
            for low, high in _sliced(self.count[at], _TESTS):
                dx[low:high], dy[low:high], closer[low:high] = self._nearest_edge(qx, qy, at[low:high])
        return np.sqrt(dx * dx + dy * dy), dx, dy, closer

    def _nearest_edge(self, qx: float, qy: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge, of = _expand(self.start[at], self.count[at])
        first = np.cumsum(self.count[at]) - self.count[at]
        x1, y1, x2, y2 = (e[edge] for e in self.ends)
        ex, ey = _way_to_segment(qx, qy, x1, y1, x2, y2)
        away = ex * ex + ey * ey
        least = np.minimum.reduceat(away, first)
        chosen = np.maximum.reduceat(np.where(away == least[of], np.arange(len(edge)), 0), first)
        dx, dy = ex[chosen], ey[chosen]
        if self.kind == "polygons":
            within = _odd(qx, qy, x1, y1, x2, y2, first)
            dx[within] = dy[within] = 0.0
        far = np.sqrt(dx * dx + dy * dy)
        ux, uy = dx / np.maximum(far, 1e-300), dy / np.maximum(far, 1e-300)
        along = np.minimum((x1 - qx) * ux[of] + (y1 - qy) * uy[of], (x2 - qx) * ux[of] + (y2 - qy) * uy[of])
        return dx, dy, np.maximum(far - np.minimum.reduceat(along, first), 0.0)

    def hits(self, px: np.ndarray, py: np.ndarray, at: np.ndarray, r: float) -> np.ndarray:
        """Does the disc around (px, py) meet the feature at ``at``?"""
        dx, dy = px - self.x[at], py - self.y[at]
        away = dx * dx + dy * dy
        if self.kind == "points":
            return away <= r * r
        hit = away <= (r * (1 - _MARGIN)) ** 2  # the anchor is a point of the feature
        open_ = np.flatnonzero(~hit & ~(away > ((r + self.half[at]) * (1 + _MARGIN)) ** 2))
        px, py, at = px[open_], py[open_], at[open_]
        if self.kind == "segments":
            hit[open_] = _segment_hits(px, py, *[e[at] for e in self.ends], r)
            return hit
        for low, high in _sliced(self.count[at], _TESTS):
            hit[open_[low:high]] = self._edges_hit(px[low:high], py[low:high], at[low:high], r)
        return hit

    def _edges_hit(self, px, py, at, r: float) -> np.ndarray:
        edge, of = _expand(self.start[at], self.count[at])
        first = np.cumsum(self.count[at]) - self.count[at]
        px, py = px[of], py[of]
        x1, y1, x2, y2 = (e[edge] for e in self.ends)
        hit = np.logical_or.reduceat(_segment_hits(px, py, x1, y1, x2, y2, r), first)
        if self.kind == "polygons":
            hit |= _odd(px, py, x1, y1, x2, y2, first)
        return hit


def _density(x: np.ndarray, y: np.ndarray, r: float) -> float:
    """Positions per square metre around a position."""
    side = max(np.ptp(x), np.ptp(y), r) / 64
    cells = np.unique(np.floor((x - x.min()) / side) * 128 + np.floor((y - y.min()) / side), return_counts=True)[1]
    return (cells.astype("float64") ** 2).sum() / len(x) / side ** 2


def _shared(centres: float, feats: float, edges: float, half: float, height: float, r: float) -> tuple[float, int] | None:
    """Side of the cells and number of sectors that cost least at these densities; None if centres had better be alone."""
    around = 2 * np.pi * r * feats
    seen, tested = _SEEN + _EDGE * edges, _TESTED + _EDGE * edges
    best, plan = around * (half + height) * tested, None
    for side in r / np.array([3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48]):
        number = max(1.0, centres * side ** 2)
        cell = _CELL + around * (1.41 * side + half + height) * seen
        bend = side ** 2 / (24 * r) if edges else 0.0  # by which a nearest point that moves along its feature may be closer
        for sectors in (16, 32, 64, 128, 256, 512):
            cost = cell / number + sectors * _LOOKED + around * (2.4 * side / sectors + bend) * tested
            if cost < best:
                best, plan = cost, (float(side), sectors)
    return plan


def disc_totals(cx: np.ndarray, cy: np.ndarray, shapes: Shapes, values: np.ndarray, r: float) -> np.ndarray:
    """Per centre, the sums of the columns of ``values`` over the features that meet its disc."""
    whole = np.isfinite(values).all(axis=1) & np.isfinite(shapes.half) & shapes.whole
    out = np.zeros((len(cx), values.shape[1]))
    for chosen, sure in ((whole, True), (~whole, False)):  # running totals must not meet an infinite value
        if chosen.any():
            sums = _Sums(shapes, np.flatnonzero(chosen), values, r)
            plan = sums.shared(cx, cy) if sure else None
            out += sums.alone(cx, cy, sure) if plan is None else sums.by_cells(cx, cy, *plan)
    return out


class _Sums:
    """Features in strips, and the ways to sum them over discs."""

    def __init__(self, shapes: Shapes, chosen: np.ndarray, values: np.ndarray, r: float):
        x, y = shapes.x[chosen], shapes.y[chosen]
        halves = shapes.half[chosen]
        self.shapes, self.r, self.measures = shapes, r, values.shape[1]
        self.half = float(halves[np.isfinite(halves)].max(initial=0.0))
        self.wide = (r + self.half) * (1 + _MARGIN)
        self.density = _density(x, y, r)
        self.height = float(np.clip(np.sqrt(20 / self.density), r / 1000, r / 4))
        self.x0, self.y0, self.width = x.min(), y.min(), np.ptp(x)
        strip = np.floor((y - self.y0) / self.height).astype("int64")
        order = np.lexsort((x, strip))
        x, strip, self.feature = x[order], strip[order], chosen[order]
        self.pad = 1e-6 * (self.width + r)
        self.pitch = self.width + 4 * self.pad
        self.last = strip[-1]
        self.key = strip * self.pitch + (x - self.x0)
        reachable = max(abs(self.x0), abs(self.x0 + self.width), abs(self.y0), abs(y.max()), (self.last + 1) * self.pitch) + self.wide
        self.margin = _MARGIN * r + 16 * np.finfo("float64").eps * reachable
        self.measured = values[self.feature]
        exact = (self.measured == np.rint(self.measured)).all() and np.abs(self.measured).sum(axis=0).max(initial=0.0) < 2.0 ** 53
        self.kind = "float64" if exact else "longdouble"
        self.running = np.zeros((len(self.feature) + 1, self.measures), self.kind)
        np.cumsum(self.measured, axis=0, out=self.running[1:])

    def shared(self, cx: np.ndarray, cy: np.ndarray) -> tuple[float, int] | None:
        if len(cx) < 2:
            return None
        return _shared(_density(cx, cy, self.r), self.density, self.shapes.edges, self.half, self.height, self.r)

    def stretches(self, px: np.ndarray, py: np.ndarray, inner_r, wide):
        """(place, a, b, c, d) per place and strip: positions a to d may be within ``wide``, b to c are within
        ``inner_r`` for sure. Both may be one number or one per place."""
        inner_r, wide = np.broadcast_to(inner_r, px.shape), np.broadcast_to(wide, px.shape)
        number = int(np.ceil(2 * wide.max() / self.height)) + 2
        first = np.floor((py - wide - self.y0) / self.height)
        of_strip = first[:, None] + np.arange(number)
        below = self.y0 + of_strip * self.height
        away = np.maximum(np.maximum(below - py[:, None], py[:, None] - below - self.height) - self.margin, 0.0)
        far = np.maximum(np.abs(below - py[:, None]), np.abs(below + self.height - py[:, None])) + self.margin
        there = (of_strip >= 0) & (of_strip <= self.last) & (away <= wide[:, None])
        row, col = np.nonzero(there)
        at, away, far = of_strip[row, col] * self.pitch, away[row, col], far[row, col]
        middle = px[row] - self.x0

        def place(at, middle, offset, side):
            return np.searchsorted(self.key, at + np.clip(middle + offset, -self.pad, self.width + self.pad), side)

        outer = np.sqrt(np.maximum(wide[row] ** 2 - away * away, 0.0)) + self.margin
        a, d = place(at, middle, -outer, "left"), place(at, middle, outer, "right")
        b, c = d.copy(), d.copy()
        within = np.flatnonzero(far < inner_r[row])
        inner = np.sqrt(inner_r[row[within]] ** 2 - far[within] ** 2) - self.margin
        within, inner = within[inner > 0], inner[inner > 0]
        left, right = place(at[within], middle[within], -inner, "left"), place(at[within], middle[within], inner, "right")
        b[within], c[within] = left, np.maximum(left, right)
        return row, a, b, c, d

    def sure(self, out: np.ndarray, mine, row, b, c) -> None:
        for m in range(self.measures):
            out[mine, m] += np.bincount(row, (self.running[c, m] - self.running[b, m]).astype("float64"), len(out[mine]))

    def tested(self, out: np.ndarray, mine, px, py, positions: np.ndarray, start, length, of) -> None:
        """Add what the features at stretches of ``positions`` (of all, if None) give to the centres ``of`` them."""
        kept = np.flatnonzero(length > 0)
        start, length, of = start[kept], length[kept], of[kept]
        for i, j in _sliced(length, _TESTS):
            position, stretch = _expand(start[i:j], length[i:j])
            if positions is not None:
                position = positions[position]
            owner = of[i:j][stretch]
            hit = self.shapes.hits(px[owner], py[owner], self.feature[position], self.r)
            owner, position = owner[hit], position[hit]
            for m in range(self.measures):
                out[mine, m] += np.bincount(owner, self.measured[position, m], len(px))

    def alone(self, cx: np.ndarray, cy: np.ndarray, sure: bool) -> np.ndarray:
        """Every centre by itself."""
        out = np.zeros((len(cx), self.measures))
        # centres in the order of the strips: their look-ups and tests stay near each other
        near = np.lexsort((cx, np.floor((cy - self.y0) / (8 * self.height))))
        number = int(np.ceil(2 * self.wide / self.height)) + 2
        step = max(1, _QUERIES // number)
        for low in range(0, len(near), step):
            mine = near[low:low + step]
            px, py = cx[mine], cy[mine]
            row, a, b, c, d = self.stretches(px, py, self.r if sure else 0.0, self.wide)
            if sure:
                self.sure(out, mine, row, b, c)
            self.tested(out, mine, px, py, None, np.concatenate([a, c]), np.concatenate([b - a, d - c]), np.concatenate([row, row]))
        return out

    def by_cells(self, cx: np.ndarray, cy: np.ndarray, side: float, sectors: int) -> np.ndarray:
        """The centres of a cell together; ``side`` is at most a third of the radius."""
        out = np.zeros((len(cx), self.measures))
        i, j = np.floor((cx - cx.min()) / side), np.floor((cy - cy.min()) / side)
        order = np.lexsort((j, i))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]))
        ends = np.append(first[1:], len(order))
        x, y = cx[order], cy[order]
        qx = (np.minimum.reduceat(x, first) + np.maximum.reduceat(x, first)) / 2
        qy = (np.minimum.reduceat(y, first) + np.maximum.reduceat(y, first)) / 2
        cell = np.repeat(np.arange(len(first)), ends - first)
        spread = np.maximum.reduceat(np.hypot(x - qx[cell], y - qy[cell]), first) + 2 * self.margin
        number = int(np.ceil(2 * (self.wide + spread.max()) / self.height)) + 2
        step = max(1, _QUERIES // number)
        core = np.zeros((len(first), self.measures))
        for low in range(0, len(first), step):
            some = slice(low, min(low + step, len(first)))
            row, a, b, c, d = self.stretches(qx[some], qy[some], self.r - spread[some], self.wide + spread[some])
            self.sure(core, some, row, b, c)
            bounds = np.searchsorted(row, np.arange(some.stop - low + 1))
            for k in range(low, some.stop):
                mine = slice(bounds[k - low], bounds[k - low + 1])
                start, length = np.concatenate([a[mine], c[mine]]), np.concatenate([(b - a)[mine], (d - c)[mine]])
                seen = _expand(start[length > 0], length[length > 0])[0]
                core[k] += self._cell(out, order[first[k]:ends[k]], cx, cy, qx[k], qy[k], spread[k], seen, sectors)
        out[order] += core[cell]
        return out

    def _cell(self, out, mine, cx, cy, qx: float, qy: float, spread: float, seen: np.ndarray, sectors: int) -> np.ndarray:
        """Add to ``out`` what the band gives to each centre of a cell; returns the sums of what all of them meet."""
        shapes, r = self.shapes, self.r
        total = np.zeros(self.measures)
        bands = []
        for low in range(0, len(seen), _TESTS):
            part = seen[low:low + _TESTS]
            at = self.feature[part]
            far, wx, wy, closer = shapes.nearest(qx, qy, at)
            all_ = far <= r - spread
            total += self.measured[part[all_]].sum(axis=0)
            open_ = np.flatnonzero(~all_ & (far <= r + spread))
            bands.append((part[open_], far[open_], np.arctan2(wy[open_], wx[open_]), closer[open_]))
        if not bands:
            return total
        seen, far, way, closer = (np.concatenate(c) for c in zip(*bands))
        limits = np.array([self.margin, r / 256, np.inf])  # kinds of features, by how far they are from being convex
        kinds = np.searchsorted(limits, closer)
        wedge = np.minimum(((way + np.pi) * (sectors / (2 * np.pi))).astype("int64"), sectors - 1)
        step = max(1, _QUERIES // sectors)
        for kind, limit in enumerate(limits):
            chosen = np.flatnonzero(kinds == kind)
            if not len(chosen):
                continue
            pitch = 4 * spread + 4 * self.margin
            key = wedge[chosen] * pitch + (far[chosen] - r)  # from -spread to spread within its sector
            rank = np.argsort(key)
            key, positions = key[rank], seen[chosen[rank]]
            begins = np.searchsorted(wedge[chosen][rank], np.arange(sectors))
            running = np.zeros((len(positions) + 1, self.measures), self.kind)
            np.cumsum(self.measured[positions], axis=0, out=running[1:])
            for low in range(0, len(mine), step):
                few = mine[low:low + step]
                px, py = cx[few], cy[few]
                least, most = self._bounds(px - qx, py - qy, sectors, limit)
                offset = np.arange(sectors) * pitch
                b = np.searchsorted(key, (offset + np.clip(least, -spread - self.margin, 2 * spread)).ravel(), "left")
                c = np.searchsorted(key, (offset + np.clip(most, -spread - self.margin, 2 * spread)).ravel(), "right")
                b = np.maximum(b, np.tile(begins, len(few)))
                c = np.maximum(b, c)
                for m in range(self.measures):
                    met = running[b, m].reshape(len(few), sectors) - running[begins, m]
                    out[few, m] += met.sum(axis=1).astype("float64")
                self.tested(out, few, px, py, positions, b, c - b, np.repeat(np.arange(len(few)), sectors))
        return total

    def _bounds(self, dx: np.ndarray, dy: np.ndarray, sectors: int, closer: float) -> tuple[np.ndarray, np.ndarray]:
        """Per centre, ``dx`` and ``dy`` from the middle, and sector: a feature up to so far from the middle meets the disc, one
        further off than the second does not (both less the radius).

        Going ``a`` towards a nearest point at distance f leaves at most sqrt(f * f - 2 * f * a + moved * moved), the way to that
        point. It leaves at least f - a - closer, and f - moved in any case.
        """
        half = np.pi / sectors
        middle = (2 * np.arange(sectors) + 1) * half - np.pi
        ahead = dx[:, None] * np.cos(middle) + dy[:, None] * np.sin(middle)
        aside = np.abs(dy[:, None] * np.cos(middle) - dx[:, None] * np.sin(middle))
        slack = np.abs(ahead) * (1 - np.cos(half)) + aside * np.sin(half) + self.margin
        moved = (dx * dx + dy * dy)[:, None]
        a, b = ahead - slack, ahead + slack
        least = a + np.sqrt(a * a + self.r ** 2 - moved) - self.r - self.margin
        if self.shapes.kind == "points":
            return least, b + np.sqrt(b * b + self.r ** 2 - moved) - self.r + self.margin
        return least, np.minimum(b + closer, np.sqrt(moved)) + self.margin


def block_sums(centres: pa.Table, feats: pa.Table, kind: str, r: float, keep: list[str], names: list[str]) -> pa.Table:
    """One row per centre of the block: its ``keep`` columns and the sums ``names``."""
    if not centres.num_rows or not feats.num_rows:
        sums = np.zeros((0, len(names)))
        centres = centres.slice(0, 0)
    else:
        values = np.stack([np.where(feats.column(n).is_null().to_numpy(), 0.0, _column(feats, n)) for n in names], axis=1)
        sums = disc_totals(_column(centres, "_px"), _column(centres, "_py"), Shapes(feats, kind), values, r)
    columns = {k: centres.column(k) for k in keep}
    return pa.table({**columns, **{n: pa.array(sums[:, i]) for i, n in enumerate(names)}})
