"""Where two streets first meet, without a shuffle of what meets.

The hits of a dense map are many times its streets, so they never travel. Streets do: a street comes, with all its
lines, to each tile one of them touches. Two lines are compared in one tile only, and there all lines of both streets
are at hand, so that the tile itself knows whether an earlier hit of the two is found elsewhere. Lines travel in
columns, by bucket of streets and then by tile, a few bytes a corner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Streets are gathered in so many parts; the lines of one, or of some of LINES in all, are in memory at once.
BUCKETS = 256
#: Lines that are dealt out at once, at least, and pairs that are worked on at once.
LINES, PAIRS = 500_000, 1 << 15
#: A tile is so many cells wide, and cut into bands of about so many lines, at most so many.
CELLS, IN_BAND, BANDS = 8, 512, 32
PACKED = "n int, whole boolean, streets binary, corners binary"


def _planes(v: np.ndarray) -> bytes:
    """Rows of numbers byte by byte, all lowest bytes of a row first, so that what is alike stands together and is compressed away."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(*v.shape, v.itemsize).swapaxes(-1, -2).tobytes()


def _numbers(data: bytes, n: int, kind: type) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).reshape(-1, np.dtype(kind).itemsize, n).swapaxes(1, 2)
    return np.ascontiguousarray(v).view(kind).reshape(-1, n)


def _steps(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners in 256ths as the steps from one to the next, sign last; and which lines are such to the bit."""
    with np.errstate(invalid="ignore"):
        whole = (corners * 256.0).astype(np.int32)
    exact = (whole / 256.0).view(np.int64) == corners.view(np.int64)
    whole[2:] -= whole[:-2].copy()
    return (whole << 1) ^ (whole >> 31), exact.all(axis=0)


def _corners(steps: np.ndarray) -> np.ndarray:
    whole = ((steps >> np.uint32(1)) ^ (np.uint32(0) - (steps & np.uint32(1)))).view(np.int32)
    for k in range(2, len(whole)):
        whole[k] += whole[k - 2]
    return whole / 256.0


def _rows(keys: dict[str, np.ndarray], cuts: np.ndarray, street: np.ndarray, corners: np.ndarray) -> pa.RecordBatch:
    """A row of packed lines for each part between cuts. corners: a row for each x and z."""
    steps, exact = _steps(corners := np.ascontiguousarray(corners))
    whole = np.logical_and.reduceat(exact, cuts[:-1])
    spans = list(zip(cuts[:-1], cuts[1:], whole, strict=True))
    kept = {k: pa.array(v[cuts[:-1]]) for k, v in keys.items()}
    kept |= {"n": pa.array(np.diff(cuts).astype(np.int32)), "whole": pa.array(whole)}
    kept |= {"streets": pa.array([_planes(np.diff(street[a:b], prepend=0)) for a, b, _ in spans], pa.binary())}
    kept |= {"corners": pa.array([_planes((steps if w else corners)[:, a:b]) for a, b, w in spans], pa.binary())}
    return pa.RecordBatch.from_pydict(kept)


def _parts(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in (*keys, "n", "whole", "streets", "corners")), strict=True)


def _lines(parts: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Street and corners of packed lines, by street."""
    streets, corners = [], []
    for *_, n, whole, s, c in parts:
        streets.append(np.cumsum(_numbers(s, n, np.int64)[0]))
        corners.append(_corners(_numbers(c, n, np.uint32)) if whole else _numbers(c, n, np.float64))
    street, corner = np.concatenate(streets), np.concatenate(corners, axis=1)
    order = np.argsort(street, kind="stable")
    return street[order], corner[:, order]


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if n else False
    return np.append(np.flatnonzero(new), n)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many of each: whose it is, and its number with that one."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - (np.cumsum(counts) - counts)[whose]


def _slices(counts: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Parts of at most so many in sum, but of one at least."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class _Pieces:
    """Lines with their ends pushed out: their segments, and boxes a hair wider than they are."""

    def __init__(self, corners: np.ndarray, extension: float, cell: float):
        x, z = corners[0::2].copy(), corners[1::2].copy()
        for end, inner in ((0, 1), (-1, -2)):
            dx, dz = corners[0::2][end] - corners[0::2][inner], corners[1::2][end] - corners[1::2][inner]
            d = np.sqrt(dx * dx + dz * dz)
            with np.errstate(invalid="ignore", divide="ignore"):
                x[end] += np.where(d > 0, dx / d, 0.0) * extension
                z[end] += np.where(d > 0, dz / d, 0.0) * extension
        self.segments = [(x[k], z[k], x[k + 1] - x[k], z[k + 1] - z[k]) for k in range(len(x) - 1)]
        hair, size = cell * 1e-9, cell * CELLS
        self.lx, self.hx, self.lz, self.hz = x.min(axis=0) - hair, x.max(axis=0) + hair, z.min(axis=0) - hair, z.max(axis=0) + hair
        self.tiles = [np.floor(v / size).astype(np.int64) for v in (self.lx, self.hx, self.lz, self.hz)]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of lines have boxes that meet."""
        at = np.flatnonzero((self.lx[a] <= self.hx[b]) & (self.lx[b] <= self.hx[a]))
        a, b = a[at], b[at]
        return at[(self.lz[a] <= self.hz[b]) & (self.lz[b] <= self.hz[a])]

    def hits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of lines a and b: which pairs meet, in which order of segments at first, x and y."""
        left, found = np.arange(len(a)), []
        for i, first in enumerate(self.segments):
            ax, az, rx, rz = (v[a] for v in first)
            for k, second in enumerate(self.segments):
                bx, bz, sx, sz = (v[b] for v in second)
                over = rx * sz - rz * sx
                qx, qz = bx - ax, bz - az
                with np.errstate(all="ignore"):  # parallels have nothing to divide by, and NaN or infinity isn't between
                    t, u = (qx * sz - qz * sx) / over, (qx * rz - qz * rx) / over
                    meet = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
                at = np.flatnonzero(meet)
                if len(at):
                    found.append((left[at], np.full(len(at), i * len(self.segments) + k), ax[at] + t[at] * rx[at], az[at] + t[at] * rz[at]))
                    rest = np.flatnonzero(~meet)
                    left, a, b, ax, az, rx, rz = (v[rest] for v in (left, a, b, ax, az, rx, rz))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (left[:0], left[:0], np.empty(0), np.empty(0))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines by bucket of their streets."""

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        street, *corners = (c.to_numpy() for c in whole.columns)
        mixed = (street.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        bucket = (mixed % np.uint64(BUCKETS)).astype(np.int32)
        order = np.lexsort((street, bucket))
        bucket = bucket[order]
        return _rows({"bucket": bucket}, _cuts(bucket), street[order], np.stack(corners)[:, order])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= LINES:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _to_tiles(cell: float, extension: float) -> Callable:
    def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Each street to each tile that one of its lines touches, with all its lines; equal lines once."""
        street, corners = _lines(parts)
        sound = np.isfinite(corners).all(axis=0)
        street, corners = street[sound], corners[:, sound]
        if not len(street):
            return
        own = np.diff(_cuts(street))
        if len(at := np.flatnonzero(np.repeat(own > 1, own))):
            order = np.arange(len(street))
            order[at] = at[np.lexsort((*corners[:, at], street[at]))]
            street, corners = street[order], corners[:, order]
            once = _cuts(street, *corners)[:-1]
            street, corners = street[once], corners[:, once]
        begins = _cuts(street)
        own = np.diff(begins)
        x0, x1, z0, z1 = _Pieces(corners, extension, cell).tiles
        deep = z1 - z0 + 1
        line, k = _counted((x1 - x0 + 1) * deep)
        tx, tz, of = x0[line] + k // deep[line], z0[line] + k % deep[line], np.repeat(np.arange(len(own)), own)[line]
        order = np.lexsort((of, tz, tx))
        tx, tz, of = tx[order], tz[order], of[order]
        once = _cuts(tx, tz, of)[:-1]
        tx, tz, of = tx[once], tz[once], of[once]
        for part in _slices(own[of], 2 * LINES):
            row, k = _counted(own[of[part]])
            line, px, pz = begins[of[part][row]] + k, tx[part][row], tz[part][row]
            yield _rows({"tx": px, "tz": pz}, _cuts(px, pz), street[line], corners[:, line])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, which come in order, until there are enough lines to go on with."""
        held, n = [], 0
        for part in _parts(batches, "bucket"):
            if n >= LINES and part[0] != held[-1][0]:
                yield from out(held)
                held, n = [], 0
            held.append(part)
            n += part[1]
        if held:
            yield from out(held)

    return run


def _first(p: _Pieces, begin: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, hit: tuple[np.ndarray, ...], corners: np.ndarray) -> np.ndarray:
    """Which hits of lines a and b are the first of their streets: no other lines of the two meet in an earlier one."""
    first = np.ones(len(a), bool)
    some = np.flatnonzero((count[a] > 1) | (count[b] > 1))
    for part in _slices(count[a[some]] * count[b[some]]):
        at = some[part]
        n = count[b[at]]
        of, k = _counted(count[a[at]] * n)
        of_hit = at[of]
        a2, b2 = begin[a[of_hit]] + k // n[of], begin[b[of_hit]] + k % n[of]
        other = p.near(a2, b2)
        other = other[(a2[other] != a[of_hit[other]]) | (b2[other] != b[of_hit[other]])]
        of_hit, a2, b2 = of_hit[other], a2[other], b2[other]
        which, *keys = p.hits(a2, b2)
        of_hit, a2, b2 = of_hit[which], a2[which], b2[which]
        earlier, even = np.zeros(len(of_hit), bool), np.ones(len(of_hit), bool)
        # Hits that are equal in all are told apart by their lines, in any tile alike.
        sides = [(c[m], c[o[of_hit]]) for m, o in ((a2, a), (b2, b)) for c in corners]
        for mine, theirs in (*((m, h[of_hit]) for m, h in zip(keys, hit, strict=True)), *sides):
            earlier |= even & (mine < theirs)
            even &= mine == theirs
        first[of_hit[earlier]] = False
    return first


def _met(cell: float, extension: float) -> Callable:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first hits of streets whose lines are compared in this tile: where the lower corner of what their boxes share is."""
        tx, tz = (k.as_py() for k in key)
        street, corners = _lines(_parts(batches))
        p = _Pieces(corners, extension, cell)
        runs = _cuts(street)
        begin, count = (np.repeat(v, np.diff(runs)) for v in (runs[:-1], np.diff(runs)))
        several = len(runs) <= len(street)
        x0, x1, z0, z1 = p.tiles
        here = np.flatnonzero((x0 <= tx) & (tx <= x1) & (z0 <= tz) & (tz <= z1))
        here = here[np.argsort(p.lx[here])]
        bands = int(min(BANDS, max(1, len(here) // IN_BAND)))
        height = cell * CELLS / bands
        low, high = (np.clip(np.floor((v - tz * cell * CELLS) / height), 0, bands - 1).astype(np.int64) for v in (p.lz, p.hz))
        before = (x0 < tx) * 1 + (z0 < tz) * 2
        for band in range(bands):
            e = here[(low[here] <= band) & (band <= high[here])]
            lx, lz, hz = p.lx[e], p.lz[e], p.hz[e]
            # Two that both begin before this tile or band are compared in an earlier one.
            began = (before[e] + (low[e] < band) * 4).astype(np.uint8)
            ahead = np.searchsorted(lx, p.hx[e], "right") - np.arange(len(e)) - 1
            for part in _slices(ahead):
                i, k = _counted(ahead[part])
                i += part.start
                j = i + k + 1
                met = np.flatnonzero((lz[i] <= hz[j]) & (lz[j] <= hz[i]) & (began[i] & began[j] == 0))
                i, j = e[i[met]], e[j[met]]
                a, b = np.minimum(i, j), np.maximum(i, j)  # lines are by street
                if several:
                    two = begin[a] != begin[b]
                    a, b = a[two], b[two]
                which, *hit = p.hits(a, b)
                a, b = a[which], b[which]
                first = _first(p, begin, count, a, b, hit, corners)
                if first.any():
                    yield pa.RecordBatch.from_pydict({"street_a": street[a[first]], "street_b": street[b[first]], "x": hit[1][first], "y": hit[2][first]})

    return run


def first_meetings(lines: DataFrame, cell: float, extension: float = 0.25) -> DataFrame:
    """Where streets first meet: street_a < street_b, x and y.

    lines has street (bigint) and its corners in order as doubles, x and z by turns; a street may have several lines,
    each with its ends pushed out by extension. First is the hit of the least segment of a, then of b, then x and y.
    Lines with a corner that is null or not finite meet nothing. Lines are put into all tiles of their boxes, so they
    should be short against CELLS cells; spatial_join.street_intersections takes long ones.
    """
    whole = lines.dropna()
    dealt = whole.mapInArrow(_dealt, f"bucket int, {PACKED}")
    tiles = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_to_tiles(cell, extension), f"tx long, tz long, {PACKED}")
    return tiles.groupBy("tx", "tz").applyInArrow(_met(cell, extension), "street_a long, street_b long, x double, y double")
