"""Solid building geometry over footprints: walls, caps and roofs as strips and height fields, a batch at a time.

Every vertical or leaning surface is a strip between two closed lines of as many points: a wall between the outline on
the ground and the outline at the eaves, a ridge roof between the eaves and the points of the ridge its corners lean
on, a skirt between the eaves and a tilted plane. Every other surface is the footprint lifted to a height field. So
corners of all features of a batch are worked on together; only outlines that are concave or have holes are cut into
triangles one by one, and each only once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-7
Point = tuple[float, float]
#: Roofs with a ridge, which need a convex footprint without holes, and how much of the ridge's reach is kept.
RIDGED = ("gabled", "hipped", "pyramidal")


def open_ring(ring: list[Point]) -> list[Point]:
    if len(ring) >= 2 and abs(ring[0][0] - ring[-1][0]) <= EPS and abs(ring[0][1] - ring[-1][1]) <= EPS:
        return ring[:-1]
    return list(ring)


def cross(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def signed_area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _visible(a: Point, b: Point, ring: list[Point]) -> bool:
    """Whether the open segment a-b meets neither an edge of ring nor a corner."""
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        if p not in (a, b) and cross(a, b, p) == 0 and (p[0] - a[0]) * (p[0] - b[0]) + (p[1] - a[1]) * (p[1] - b[1]) < 0:
            return False
        if p in (a, b) or q in (a, b):
            continue
        if cross(a, b, p) * cross(a, b, q) < 0 and cross(p, q, a) * cross(p, q, b) < 0:
            return False
    return True


def bridged(outer: list[Point], holes: list[list[Point]]) -> list[Point]:
    """One ring: each hole joined to what is there already by a cut to the nearest corner it can see."""
    ring = outer if signed_area(outer) > 0 else outer[::-1]
    todo = [h if signed_area(h) < 0 else h[::-1] for h in holes if len(h) >= 3]
    for hole in sorted(todo, key=lambda h: -max(p[0] for p in h)):
        start = max(range(len(hole)), key=lambda i: hole[i][0])
        h = hole[start:] + hole[:start]
        others = [o for o in todo if o is not hole]
        order = sorted(range(len(ring)), key=lambda i: math.dist(ring[i], h[0]))
        at = next((i for i in order if _visible(h[0], ring[i], ring) and _visible(h[0], ring[i], h) and all(_visible(h[0], ring[i], o) for o in others)), order[0])
        ring = ring[: at + 1] + h + [h[0]] + ring[at:]
    return ring


def _blocked(ring: list[Point], at: list[int], a: Point, b: Point, c: Point) -> bool:
    """Whether a corner lies within the ear a-b-c or on its cut c-a, or an edge crosses the cut."""
    for n, i in enumerate(at):
        p, q = ring[i], ring[at[(n + 1) % len(at)]]
        if p not in (a, b, c):
            side = cross(c, a, p)
            if side > 0 and cross(a, b, p) > 0 and cross(b, c, p) > 0:
                return True
            if side == 0 and (p[0] - a[0]) * (p[0] - c[0]) + (p[1] - a[1]) * (p[1] - c[1]) < 0:
                return True
        if cross(a, c, p) * cross(a, c, q) < 0 and cross(p, q, a) * cross(p, q, c) < 0:
            return True
    return False


def _opens_inward(ring: list[Point], at: list[int], k: int, to: Point, back: bool = False) -> bool:
    """Whether the cut from the corner before k (back: from the corner k) to a point runs within the corner's angle."""
    i = k if back else (k - 1) % len(at)
    p, before, after = ring[at[i]], ring[at[i - 1]], ring[at[(i + 1) % len(at)]]
    if cross(before, p, after) >= 0:
        return cross(before, p, to) >= 0 and cross(p, after, to) >= 0
    return cross(before, p, to) >= 0 or cross(p, after, to) >= 0


def triangulate(rings: list[list[Point]]) -> list[tuple[Point, Point, Point]]:
    """Ear clipping of an area with holes; triangles turn left."""
    rings = [open_ring(r) for r in rings]
    if not rings or len(rings[0]) < 3:
        return []
    ring, out = bridged(rings[0], rings[1:]), []
    at = list(range(len(ring)))
    while len(at) > 3:
        for k in range(len(at)):
            i, j, m = at[k - 1], at[k], at[(k + 1) % len(at)]
            a, b, c = ring[i], ring[j], ring[m]
            if cross(a, b, c) <= 0:
                continue
            if _blocked(ring, at, a, b, c):
                continue
            # Where a cut to a hole ends, the ear must lie on the inner side of the outline.
            if not _opens_inward(ring, at, k, c) or not _opens_inward(ring, at, (k + 1) % len(at), a, back=True):
                continue
            out.append((a, b, c))
            at.pop(k)
            break
        else:  # nothing but degenerate corners is left: drop the flattest
            k = min(range(len(at)), key=lambda k: abs(cross(ring[at[k - 1]], ring[at[k]], ring[at[(k + 1) % len(at)]])))
            at.pop(k)
    if len(at) == 3 and abs(cross(*(ring[i] for i in at))) > 0:
        out.append(tuple(ring[i] for i in at))
    return out


class Footprints:
    """Corners of a batch's footprints as flat arrays, with each one's feature, ring and following corner.

    Closing points are dropped; so are rings of fewer than three corners, with their holes where it is the outline.
    """

    def __init__(self, rings: pa.Array, n: int) -> None:
        lists = rings.flatten()
        points = lists.flatten()
        owner = pc.list_parent_indices(rings).to_numpy().astype(np.int64)
        ring = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        x, z = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
        ordinal = np.arange(len(owner)) - np.searchsorted(owner, owner)
        ok = np.isfinite(x) & np.isfinite(z)
        ring, x, z = ring[ok], x[ok], z[ok]
        first = np.searchsorted(ring, ring)
        last = np.searchsorted(ring, ring, side="right") - 1
        k = np.arange(len(ring))
        keep = ~((k == last) & (last > first) & (np.abs(x - x[first]) <= EPS) & (np.abs(z - z[first]) <= EPS))
        ring, x, z = ring[keep], x[keep], z[keep]
        fit = np.bincount(ring, minlength=len(owner)) >= 3
        outlined = np.zeros(n, bool)
        outlined[owner[fit & (ordinal == 0)]] = True
        keep = fit[ring] & outlined[owner[ring]]
        self.n, self.ring, self.x, self.z = n, ring[keep], x[keep], z[keep]
        self.of, self.outer = owner[self.ring], ordinal[self.ring] == 0
        end = np.append(self.ring[1:] != self.ring[:-1], True) if len(self.ring) else np.empty(0, bool)
        self.next = np.arange(len(self.ring)) + 1
        self.next[end] = np.searchsorted(self.ring, self.ring[end])
        self.rings = np.bincount(owner[np.unique(self.ring)], minlength=n)
        self.convex = self._convex() & (self.rings == 1)

    def _convex(self) -> np.ndarray:
        """Features whose outline turns one way only, straight corners aside."""
        dx, dz = self.x[self.next] - self.x, self.z[self.next] - self.z
        turn = dx * dz[self.next] - dz * dx[self.next]
        some = lambda which: np.bincount(self.of[self.outer & which], minlength=self.n) > 0
        return some(turn > EPS * EPS) != some(turn < -EPS * EPS)

    def most(self, values: np.ndarray, none: float) -> np.ndarray:
        """Greatest value among the outline's corners of each feature."""
        out = np.full(self.n, none)
        np.maximum.at(out, self.of[self.outer], values[self.outer])
        return out

    def triangles(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature, corner numbers) of triangles that cover the footprints: fans of convex ones, ears of the others."""
        start = np.searchsorted(self.of, self.of)
        k = np.arange(len(self.of))
        fan = self.convex[self.of] & (k > start) & (self.next != start)
        of, corners = [self.of[fan]], [np.stack([start[fan], k[fan], self.next[fan]], 1)]
        for f in np.unique(self.of[~self.convex[self.of]]):
            lo, hi = np.searchsorted(self.of, [f, f + 1])
            parts = np.split(np.arange(lo, hi), np.flatnonzero(np.diff(self.ring[lo:hi])) + 1)
            number: dict[Point, int] = {}
            rings = [[(float(self.x[i]), float(self.z[i])) for i in p] for p in parts]
            for p, r in zip(parts, rings, strict=True):
                number |= dict(zip(r, p.tolist(), strict=True))
            cut = triangulate(rings)
            of.append(np.full(len(cut), f))
            corners.append(np.array([[number[p] for p in t] for t in cut], np.int64).reshape(-1, 3))
        return np.concatenate(of), np.concatenate(corners)


def facing_up(of: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Faces (m, 3 corners, x y z) without those of no area; all look up, upright ones lie there both ways."""
    normal = np.cross(faces[:, 1] - faces[:, 0], faces[:, 2] - faces[:, 0])
    real = np.abs(normal).max(axis=1, initial=0) > EPS * EPS
    of, faces, up = of[real], faces[real], normal[real, 1]
    faces = np.where((up < 0)[:, None, None], faces[:, ::-1], faces)
    upright = np.abs(up) <= EPS * EPS
    return np.concatenate([of, of[upright]]), np.concatenate([faces, faces[upright][:, ::-1]])


def strip(p: Footprints, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two faces to each edge between the lines low and high, both (corners, x y z). Where they all but meet they do."""
    high = np.where(np.abs(high - low).max(axis=1, initial=0, keepdims=True) <= EPS, low, high)
    i = np.flatnonzero(which)
    j = p.next[i]
    return np.tile(p.of[i], 2), np.concatenate([np.stack([low[i], low[j], high[j]], 1), np.stack([low[i], high[j], high[i]], 1)])


def solids(p: Footprints, height: np.ndarray, shape: np.ndarray, rise: np.ndarray, bearing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(wall height, roof built, cap area of each feature; feature and corners of all faces).

    shape: '' for a flat roof. bearing in degrees, NaN where the longer side of the box gives the ridge (ties: x).
    """
    n = p.n
    some = np.bincount(p.of, minlength=n) > 0
    built = some & (rise > 0) & ((np.isin(shape, RIDGED) & p.convex) | (shape == "skillion"))
    wall = np.where(built, height - rise, height)
    lo_hi = [(-p.most(-v, -np.inf), p.most(v, -np.inf)) for v in (p.x, p.z)]
    with np.errstate(invalid="ignore"):
        (cx, wx), (cz, wz) = (((lo + hi) / 2, hi - lo) for lo, hi in lo_hi)
        lies = np.where(wx >= wz, 0.0, 90.0)
    given = np.isfinite(bearing)
    ridge = np.radians(np.where(given, bearing, lies))
    fall = np.radians(np.where(given, bearing - 90, lies + 90))
    dx, dz = p.x - cx[p.of], p.z - cz[p.of]
    turned = lambda angle: (np.round(np.cos(angle), 15)[p.of], np.round(np.sin(angle), 15)[p.of])
    (rx, rz), (fx, fz) = turned(ridge), turned(fall)
    along, down = dx * rx + dz * rz, dx * fx + dz * fz
    reach, depth = (np.maximum(p.most(np.abs(v), EPS), EPS) for v in (along, down))

    at = lambda h: np.stack([p.x, h, p.z], 1)
    base = wall[p.of]
    parts = [strip(p, base > EPS, at(np.zeros(len(p.x))), at(base))]
    # A tilted roof lifts each corner; a flat one is lifted by nothing. Both are the footprint's own triangles.
    tilted = built & (shape == "skillion")
    lift = base + np.where(tilted[p.of], (down / depth[p.of] + 1) / 2 * rise[p.of], 0.0)
    parts.append(strip(p, tilted[p.of], at(base), at(lift)))
    of, corners = p.triangles()
    area = np.zeros(n)
    a, b, c = (corners[:, i] for i in range(3))
    np.add.at(area, of, np.abs((p.x[b] - p.x[a]) * (p.z[c] - p.z[a]) - (p.z[b] - p.z[a]) * (p.x[c] - p.x[a])) / 2)
    parts.append((of, at(lift)[corners]))
    # Ridge roofs: each corner leans on the nearest point of the ridge, which may be a single one.
    ridged = built & ~tilted
    half = np.select([shape == "gabled", shape == "hipped"], [reach, np.maximum(reach - depth, 0.0)], 0.0)
    half = np.where(half <= EPS, 0.0, half)
    lean = np.clip(along, -half[p.of], half[p.of])
    top = np.stack([cx[p.of] + lean * rx, base + rise[p.of], cz[p.of] + lean * rz], 1)
    parts.append(strip(p, ridged[p.of], at(base), top))
    of, faces = facing_up(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
    return wall, built, area, of, faces


OUT = "id bigint, wall_height double, roof_built boolean, n_triangles int, cap_area double, top double, positions array<double>, indices array<int>"


def build(features: DataFrame, scale: float = 1.0) -> DataFrame:
    """Meshes of features (id, rings ARRAY<ARRAY<STRUCT x, z>>, height, shape, roof_height, bearing).

    Null or empty rings give a mesh without triangles; a null height counts as 0; a null shape is a flat roof. Where
    the roof can't be built the walls go up to the full height. positions are x, y, z of each triangle's corners in
    turn. Every footprint has its cap at the eaves, under a ridge roof too.
    """

    def meshes(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        number = lambda i: np.nan_to_num(b.column(i).to_numpy(zero_copy_only=False).astype(float))
        height = np.maximum(number(2), 0.0)
        shape = np.array([s or "" for s in b.column(3).to_pylist()])
        rise = np.clip(number(4), 0.0, height)
        bearing = b.column(5).to_numpy(zero_copy_only=False).astype(float)
        p = Footprints(b.column(1), n)
        wall, built, area, of, faces = solids(p, height * scale, shape, rise * scale, bearing)
        order = np.argsort(of, kind="stable")
        of, faces = of[order], faces[order]
        count = np.bincount(of, minlength=n)
        begin = np.append(0, np.cumsum(count))
        top = np.zeros(n)
        np.maximum.at(top, of, faces[:, :, 1].max(axis=1, initial=0))
        lists = lambda per, v: pa.ListArray.from_arrays(pa.array((begin * per).astype(np.int32)), pa.array(v))
        within = np.arange(len(of) * 3) - np.repeat(begin[:-1][of] * 3, 3)
        columns = [b.column(0), pa.array(wall / scale), pa.array(built), pa.array(count, pa.int32()), pa.array(area), pa.array(top), lists(9, faces.reshape(-1)), lists(3, within.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                yield meshes(b.slice(lo, 4096))

    return features.select(F.col("id").cast("bigint"), "rings", F.col("height").cast("double"), "shape", F.col("roof_height").cast("double"), F.col("bearing").cast("double")).mapInArrow(run, OUT)
