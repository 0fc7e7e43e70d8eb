"""New batches of features checked against all accepted ones, without reprocessing the history.

A shape is written as a stream of corners: closing and repeated points dropped, rings run one way, coordinates in
Web-Mercator metres. The stream is cut by content: a rolling hash over neighbouring corners sets the boundaries
(cyclic, so the first corner doesn't matter), and each chunk is known by its hash. A header chunk leads the stream:
kind of shape and the cell of its middle; a shape also looks in the cells its middle may reach within the tolerance,
so that two shapes that match always share a header, whatever became of their corners.

The history is a chunk-to-record table on disk, bucketed by hash: a batch's hashes are brought to its buckets, the
table itself is neither shuffled nor rewritten. The join yields the bytes a new shape shares with each held one. Coverage
decides: all bytes shared either way is the same outline, no header shared is another one; what lies between (corners
that differ by a little) is decided by the exact distance between corners and outlines. Chunks of accepted shapes are
appended.

Within a batch, shapes with one and the same stream are settled with their first. The others are taken in order cell by
cell, each cell's rows in one pass; what hangs on a neighbouring cell waits for a further pass. A cell with more rows
than LIMIT is split: its first rows are settled, the others are compared in parts with the accepted ones only.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import drop, hadoop_path, scratch, stored

EARTH_A = 6378137.0
#: Side of the cells of the middle, in Web-Mercator metres, and of the cells corners are hashed by.
CELL, GRAIN = 16.0, 0.05
#: One corner in so many ends a chunk.
MEAN_CHUNK = 4
#: Bytes of a corner and of a header; no chunk of corners has as few as a header.
CORNER_BYTES, HEADER_BYTES = 16, 8
#: Rows of a cell that are settled in one task; a header more of a batch's rows share is probed in parts.
LIMIT = 50_000
AREA, LINE, POINT = 1, 2, 3
CLASS = {"Polygon": AREA, "MultiPolygon": AREA, "LineString": LINE, "MultiLineString": LINE, "Point": POINT, "MultiPoint": POINT}
#: Batch number of rows without one: they come last.
NO_BATCH = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shapes:
    """Shapes of a batch of rows as flat arrays: row, ring (numbered over the batch), x, y in Mercator metres."""

    def __init__(self, row: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.row, self.ring, self.x, self.y = row, ring, x, y


NUMERIC = np.zeros(256, bool)
NUMERIC[np.frombuffer(b"0123456789+-.eE", np.uint8)] = True
KNOWN = NUMERIC.copy()
KNOWN[np.frombuffer(b"[], \t\r\n\0", np.uint8)] = True
TO_BLANK = bytes(c if NUMERIC[c] else 32 for c in range(256))


def _positions(v: object, out: list, ring: int) -> int:
    """Positions of nested JSON coordinates as (ring, x, y); returns the next ring number."""
    if not isinstance(v, list) or not v:
        return ring
    if isinstance(v[0], (int, float)) and not isinstance(v[0], bool):
        if len(v) >= 2 and isinstance(v[1], (int, float)):
            out.append((ring, float(v[0]), float(v[1])))
        return ring + 1
    if isinstance(v[0], list) and v[0] and isinstance(v[0][0], (int, float)):
        for p in v:
            if isinstance(p, list) and len(p) >= 2 and all(isinstance(c, (int, float)) for c in p[:2]):
                out.append((ring, float(p[0]), float(p[1])))
        return ring + 1
    for x in v:
        ring = _positions(x, out, ring)
    return ring


def read_coordinates(texts: list[bytes | None]) -> Shapes:
    """All texts of a batch at once: structure from the brackets, numbers in one pass; odd texts one by one."""
    parts, odd, rings = [], [], 0
    todo = [[i for i, t in enumerate(texts) if t]]
    while todo:
        at = todo.pop()
        got = _read_flat(b"\0".join(texts[i] for i in at), len(at)) if at else None
        if got is not None:
            row, ring, x, y = got
            parts.append((np.array(at, np.int64)[row], ring + rings, x, y))
            rings += int(ring.max()) + 1 if len(ring) else 0
        elif len(at) > 32:  # something odd is among them
            todo += [at[: len(at) // 2], at[len(at) // 2 :]]
        else:
            odd += at
    for i in odd:
        out: list = []
        try:
            rings = _positions(json.loads(texts[i] or b"null"), out, rings)
        except (ValueError, RecursionError):
            continue
        if out:
            parts.append((np.full(len(out), i), np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])))
    if not parts:
        none = np.empty(0)
        return Shapes(none.astype(np.int64), none.astype(np.int64), none, none)
    row, ring, x, y = (np.concatenate([p[k] for p in parts]) for k in range(4))
    ok = np.isfinite(x) & np.isfinite(y)
    row, ring, x, y = row[ok], ring[ok], x[ok], y[ok]
    # Numbers that can't be degrees make the whole row metres.
    far = (np.abs(x) > 180) | (np.abs(y) > 90)
    metres = np.zeros(len(texts), bool)
    metres[row[far]] = True
    deg = ~metres[row]
    lat = np.clip(y[deg], -89.99, 89.99)
    x, y = x.copy(), y.copy()
    x[deg] = np.radians(x[deg]) * EARTH_A
    y[deg] = np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * EARTH_A
    return Shapes(row, ring, x, y)


def _read_flat(buf: bytes, n: int) -> tuple | None:
    a = np.frombuffer(buf, np.uint8)
    line = np.cumsum(a == 0)
    if not KNOWN[a].all() or line[-1] != n - 1:
        return None
    depth = np.cumsum((a == 91).astype(np.int64) - (a == 93))
    if depth[-1] or depth[a == 0].any():  # brackets that don't close
        return None
    num = NUMERIC[a]
    start = np.flatnonzero(num & ~np.concatenate(([False], num[:-1])))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # a text that isn't all numbers
            values = np.fromstring(buf.translate(TO_BLANK).decode(), sep=" ")
    except (ValueError, DeprecationWarning):
        return None
    if len(values) != len(start):
        return None
    # The last bracket or comma before each byte.
    mark = (a == 91) | (a == 93) | (a == 44) | (a == 0)
    last = np.maximum.accumulate(np.where(mark, np.arange(len(a)), -1))
    before = last[start]
    first = np.flatnonzero((before >= 0) & (a[before] == 91))
    if not len(first):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0), np.empty(0)
    size = np.diff(np.append(first, len(start)))
    if (size < 2).any() or first[0] != 0:
        return None
    row = line[start[first]]
    if (row != line[start[first + 1]]).any():
        return None
    bracket = before[first]
    prior = np.where(bracket > 0, last[bracket - 1], -1)
    # A position begins a ring if another bracket opens just before its own, or its row does.
    new = (prior < 0) | (a[prior] != 44)
    new[0] = True
    return row, np.cumsum(new) - 1, values[first], values[first + 1]


def canonical(s: Shapes) -> Shapes:
    """Closing points and repeated neighbours dropped; order of rows and rings kept."""
    if not len(s.x):
        return s
    begins = np.concatenate(([True], s.ring[1:] != s.ring[:-1]))
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(s.x)))
    head, tail = np.repeat(at, size), np.repeat(at + size - 1, size)
    k = np.arange(len(s.x))
    close = (k == tail) & (size.repeat(size) > 1) & (np.hypot(s.x - s.x[head], s.y - s.y[head]) < 1e-3)
    prev = np.maximum(k - 1, 0)
    twin = ~begins & (np.hypot(s.x - s.x[prev], s.y - s.y[prev]) < 1e-3)
    keep = ~(close | twin)
    return Shapes(s.row[keep], s.ring[keep], s.x[keep], s.y[keep])


def content_chunks(s: Shapes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, bytes) of the corner chunks, each once a row. kind: class of each row. Rings count as cyclic, lines don't matter."""
    if not len(s.x):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    qx, qy = (np.rint(v / GRAIN).astype(np.int64).astype(np.uint64) for v in (s.x, s.y))
    with np.errstate(over="ignore"):
        t = mix(qx * np.uint64(0x9E3779B97F4A7C15) + mix(qy + kind[s.row].astype(np.uint64)))
    begins = np.concatenate(([True], s.ring[1:] != s.ring[:-1]))
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(t)))
    head = np.repeat(at, size)
    nxt = np.where(np.arange(len(t)) + 1 < head + size.repeat(size), np.arange(len(t)) + 1, head)
    # The rolling window holds a corner and the next; a sum, so that either direction gives the same.
    with np.errstate(over="ignore"):
        roll = mix(t + t[nxt])
    ends = roll % np.uint64(MEAN_CHUNK) == 0
    piece = np.cumsum(ends) - ends
    ring_no = np.cumsum(begins) - 1
    # What follows a ring's last boundary belongs with what precedes its first one.
    last_end = np.zeros(len(at), np.int64) - 1
    np.maximum.at(last_end, ring_no[ends], piece[ends] + 1)
    first_piece = piece[at]
    over = piece == last_end[ring_no]
    piece = np.where(over & (last_end[ring_no] >= 0), first_piece[ring_no], piece)
    key = ring_no * (piece.max() + 2) + piece
    _, code = np.unique(key, return_inverse=True)
    h = np.zeros(code.max() + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(h, code, roll)
    row = np.zeros(len(h), np.int64)
    row[code] = s.row
    h, size = mix(h), np.bincount(code) * CORNER_BYTES
    # A ring given twice in a row has its chunks once, or they would stand for others the row lacks.
    order = np.lexsort((h, row))
    once = order[np.concatenate(([True], (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])))]
    return row[once], h[once], size[once]


def header_chunks(s: Shapes, kind: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, own) of header chunks: own for the middle's cell, else a cell the middle may reach."""
    if not len(s.x):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    order = np.argsort(s.row, kind="stable")
    row, x, y = s.row[order], s.x[order], s.y[order]
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    rows = row[at]
    lo_hi = lambda v: (np.minimum.reduceat(v, at) + np.maximum.reduceat(v, at)) / 2
    mx, my = lo_hi(x), lo_hi(y)
    slack = tolerance * np.cosh(my / EARTH_A) * 1.02 + 0.01  # Mercator stretches by cosh(y / a)
    own = np.floor(mx / CELL).astype(np.int64), np.floor(my / CELL).astype(np.int64)
    x0, x1, y0, y1 = (np.floor(v / CELL).astype(np.int64) for v in (mx - slack, mx + slack, my - slack, my + slack))
    wide = x1 - x0 + 1
    count = wide * (y1 - y0 + 1)
    who = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    cx, cy = x0[who] + step % wide[who], y0[who] + step // wide[who]
    with np.errstate(over="ignore"):
        h = mix(cx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(cy.astype(np.uint64) * np.uint64(8) + kind[rows[who]].astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)))
    return rows[who], h, (cx == own[0][who]) & (cy == own[1][who])


def ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of count members: each member's group, and its place within."""
    count = np.asarray(count, np.int64)
    who = np.repeat(np.arange(len(count)), count)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


#: Shorts before the ring sizes: anchor x and y, whether offsets are short, number of rings.
FIXED = 7


def pack(start: np.ndarray, end: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Shapes in bytes, corners [start, end) each: anchor, ring sizes, corners in centimetres from the anchor."""
    corners = end - start
    who, within = ragged(corners)
    ax, ay = np.rint(x[start]), np.rint(y[start])
    dx, dy = np.rint((x - ax[who]) * 100).astype(np.int64), np.rint((y - ay[who]) * 100).astype(np.int64)
    small = np.maximum(np.maximum.reduceat(np.abs(dx), start), np.maximum.reduceat(np.abs(dy), start)) < 32000
    opens = np.concatenate(([True], (ring[1:] != ring[:-1]) | (who[1:] != who[:-1])))
    ring_at = np.flatnonzero(opens)
    size, ring_of = np.diff(np.append(ring_at, len(x))), who[ring_at]
    rings = np.bincount(ring_of, minlength=len(start))
    length = FIXED + 2 * rings + corners * np.where(small, 2, 4)
    at = np.cumsum(length) - length
    buf = np.zeros(int(length.sum()), np.int16)
    two = lambda v: v.astype(np.int32).view(np.int16).reshape(-1, 2)
    for k, v in ((0, ax), (2, ay), (5, rings)):
        buf[at[:, None] + [k, k + 1]] = two(v)
    buf[at + 4] = small
    nth = np.arange(len(ring_of)) - (np.cumsum(rings) - rings)[ring_of]
    buf[(at[ring_of] + FIXED + 2 * nth)[:, None] + [0, 1]] = two(size)
    base, s = at[who] + FIXED + 2 * rings[who], small[who]
    buf[(base[s] + 2 * within[s])[:, None] + [0, 1]] = np.stack([dx[s], dy[s]], 1).astype(np.int16)
    if not s.all():
        buf[(base[~s] + 4 * within[~s])[:, None] + [0, 1, 2, 3]] = np.hstack([two(dx[~s]), two(dy[~s])])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(at, len(buf)).astype(np.int32) * 2), pa.py_buffer(buf)])


class Packed:
    """Packed shapes read again: corners of all, with each shape's first corner and number, and each corner's ring."""

    def __init__(self, blobs: pa.Array) -> None:
        blobs = pa.concat_arrays([blobs.cast(pa.binary())])
        offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) // 2
        d = np.frombuffer(blobs.buffers()[2], np.int16, len(blobs.buffers()[2]) // 2)
        at = offsets[:-1]
        two = lambda i: np.ascontiguousarray(d[i[:, None] + [0, 1]]).view(np.int32).ravel()
        ax, ay, small, rings = two(at), two(at + 2), d[at + 4] != 0, two(at + 5)
        ring_of, nth = ragged(rings)
        size = two(at[ring_of] + FIXED + 2 * nth)
        self.count = np.bincount(ring_of, size, len(at)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        who, within = ragged(self.count)
        base, s = at[who] + FIXED + 2 * rings[who], small[who]
        x, y = np.empty(len(who), np.int64), np.empty(len(who), np.int64)
        x[s], y[s] = d[base[s] + 2 * within[s]], d[base[s] + 2 * within[s] + 1]
        if not s.all():
            i = base[~s] + 4 * within[~s]
            x[~s], y[~s] = two(i), two(i + 2)
        self.x, self.y = x / 100.0 + ax[who], y / 100.0 + ay[who]
        self.ring = np.repeat(np.arange(len(size)), size)

    def segments(self, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector from each corner to the next of its ring; from the last one to the first where shapes are areas."""
        last = np.append(self.ring[1:] != self.ring[:-1], True)
        begin = np.flatnonzero(np.concatenate(([True], last[:-1])))
        nxt = np.arange(len(self.x)) + 1
        closes = np.repeat(area, self.count)[last]
        nxt[last] = np.where(closes, begin, np.flatnonzero(last))
        return self.x[nxt] - self.x, self.y[nxt] - self.y


#: Corner-segment distances worked out at once.
BLOCK = 1 << 20


class Outlines:
    """Packed shapes that are compared by their numbers: which pairs are the same shape."""

    def __init__(self, blobs: pa.Array, kind: np.ndarray, tolerance: float) -> None:
        self.kind, self.p = kind, Packed(blobs)
        self.dx, self.dy = self.p.segments(kind == AREA)
        p, at = self.p, self.p.first
        self.box = np.stack([np.minimum.reduceat(p.x, at), np.maximum.reduceat(p.x, at), np.minimum.reduceat(p.y, at), np.maximum.reduceat(p.y, at)], 1)
        # Mercator stretches by cosh(y / a); two centimetres are what packing may have moved.
        self.most = tolerance * np.cosh(np.add.reduceat(p.y, at) / p.count / EARTH_A) + 0.02

    def _squares(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distance of corners i from the segments that begin at corners j."""
        px, py, dx, dy = self.p.x[i] - self.p.x[j], self.p.y[i] - self.p.y[j], self.dx[j], self.dy[j]
        long = dx**2 + dy**2
        u = np.clip((px * dx + py * dy) / np.where(long == 0, 1, long), 0, 1)
        return (px - u * dx) ** 2 + (py - u * dy) ** 2

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest distance of a corner of shape a from the outline of shape b, for each pair."""
        p, out = self.p, np.zeros(len(a))
        work = p.count[a] * p.count[b]
        block = np.cumsum(work) // BLOCK
        for k in np.unique(block):
            of = np.flatnonzero(block == k)
            s, t = a[of], b[of]
            if len(of) == 1 and work[of[0]] > BLOCK:  # long outlines: some corners at a time
                j = p.first[t[0]] + np.arange(p.count[t[0]])
                step = max(1, BLOCK // len(j))
                for lo in range(0, int(p.count[s[0]]), step):
                    i = p.first[s[0]] + np.arange(lo, min(lo + step, p.count[s[0]]))
                    out[of[0]] = max(out[of[0]], np.sqrt(self._squares(i[:, None], j[None, :]).min(axis=1).max()))
                continue
            who, i = ragged(p.count[s])
            of_corner, j = ragged(p.count[t][who])
            near = np.minimum.reduceat(self._squares((p.first[s][who] + i)[of_corner], p.first[t][who][of_corner] + j), np.cumsum(p.count[t][who]) - p.count[t][who])
            out[of] = np.sqrt(np.maximum.reduceat(near, np.cumsum(p.count[s]) - p.count[s]))
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of numbers: of one kind, and every corner of either within tolerance of the other's outline."""
        ok = (self.kind[a] == self.kind[b]) & (np.abs(self.box[a] - self.box[b]).max(axis=1, initial=0) <= self.most[a])
        for s, t in ((a, b), (b, a)):
            left = np.flatnonzero(ok)
            if len(left):
                ok[left] = self._far(s[left], t[left]) <= self.most[a[left]]
        return ok


PARSED = "b bigint, r bigint, kind tinyint, shape binary, own bigint, fp bigint, total int, hashes array<bigint>, sizes array<int>"


def parse_features(features: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Of each feature with a readable position: batch, row_id, kind, shape, its own header, a fingerprint of its stream, and its chunks, headers first."""
    narrow = features.filter(F.col("row_id").isNotNull()).select(F.coalesce(F.col("batch_no").cast("bigint"), F.lit(NO_BATCH)).alias("b"), F.col("row_id").cast("bigint").alias("r"), F.col("geometry_type").cast("string"), F.col("coordinates").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                yield _parse(b.slice(lo, 4096), tolerance)

    return narrow.mapInArrow(run, PARSED)


def _parse(b: pa.RecordBatch, tolerance: float) -> pa.RecordBatch:
    kind = np.array([CLASS.get(k, 0) for k in b.column(2).to_pylist()], np.int64)
    texts = [None if t is None or not k else t for t, k in zip(b.column(3).cast(pa.binary()).to_pylist(), kind, strict=True)]
    s = canonical(read_coordinates(texts))
    hr, hh, own = header_chunks(s, kind, tolerance)
    cr, ch, cb = content_chunks(s, kind)
    rows = np.unique(s.row)
    so = np.argsort(s.row, kind="stable")
    s0, s1 = (np.searchsorted(s.row[so], rows, side=x) for x in ("left", "right"))
    shape = pack(s0, s1, s.ring[so], s.x[so], s.y[so]) if len(rows) else pa.array([], pa.binary())
    row, h, size = np.concatenate([hr, cr]), np.concatenate([hh, ch]), np.concatenate([np.full(len(hr), HEADER_BYTES), cb])
    order = np.argsort(row, kind="stable")
    edge = np.append(np.searchsorted(row[order], rows), len(row)).astype(np.int32)
    place = np.searchsorted(rows, cr)
    sums, total = np.zeros(len(rows), np.uint64), np.full(len(rows), HEADER_BYTES) + np.bincount(place, cb, len(rows)).astype(np.int64)
    with np.errstate(over="ignore"):
        np.add.at(sums, place, ch)
        fp = mix(sums + kind[rows].astype(np.uint64) + total.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own_hash = np.zeros(len(rows), np.uint64)
    own_hash[np.searchsorted(rows, hr[own])] = hh[own]
    lists = lambda v, t: pa.ListArray.from_arrays(pa.array(edge), pa.array(v, t))
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(kind[rows], pa.int8()), shape, pa.array(own_hash.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(total, pa.int32()), lists(h[order].view(np.int64), pa.int64()), lists(size[order].astype(np.int32), pa.int32())], names=[x.split()[0] for x in PARSED.split(", ")])


def chunk_rows(parsed: DataFrame, *more: str) -> DataFrame:
    """hash, nbytes, b, r, own and more: the chunks of each record, with the headers it may share."""
    return parsed.select(F.explode(F.arrays_zip("hashes", "sizes")).alias("c"), "b", "r", "own", *more).select(F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("nbytes"), "b", "r", "own", *more)


def same_pairs(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Those pairs (any columns, then kind, shape and shape_m) that are the same shape, without these three."""
    keep = pairs.columns[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = x.num_rows
            if n:
                kind, a, b = (x.column(len(keep) + i) for i in range(3))
                o = Outlines(pa.concat_arrays([a.cast(pa.binary()), b.cast(pa.binary())]), np.tile(kind.to_numpy(), 2), tolerance)
                yield x.select(keep).filter(pa.array(o.same(np.arange(n), np.arange(n, 2 * n))))

    return pairs.mapInArrow(run, pairs.select(keep).schema)


def settle_cells(cell: np.ndarray, mine: np.ndarray, held: np.ndarray, probe: np.ndarray, outlines: Outlines) -> tuple[np.ndarray, np.ndarray]:
    """(best, wait) of rows sorted by cell, then order: the accepted row each matches first, and whether it has to wait.

    Row by row, cell side by side: a row that matches no earlier one is taken, and later ones that match it are its
    repeats. held rows are accepted already. The verdict on rows of other cells (neither mine nor held) isn't known
    here, so what matches one of them first has to wait. probe rows are only compared, they settle nothing.
    """
    n = len(cell)
    best, wait = np.full(n, -1), np.zeros(n, bool)
    begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if n else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    now, rows = begins.copy(), np.arange(n)
    while len(rows):
        # The next row of each cell that may settle others, and the later ones that are still open.
        fit = rows[(rows >= now[group[rows]]) & (best[rows] < 0) & ~probe[rows]]
        if not len(fit):
            break
        g, first = np.unique(group[fit], return_index=True)
        ref = np.full(len(begins), n)
        ref[g] = fit[first]
        now = ref + 1
        rows = rows[rows >= ref[group[rows]]]
        later = rows[(rows > ref[group[rows]]) & (best[rows] < 0) & ~wait[rows] & ~held[rows]]
        rows = rows[np.isin(group[rows], group[later])]
        hit = later[outlines.same(ref[group[later]], later)]
        by = ref[group[hit]]
        sure = held[by] | (mine[by] & ~wait[by])
        best[hit[sure]], wait[hit[~sure]] = by[sure], True
    return best, wait


VERDICT = "b bigint, r bigint, tb bigint, tr bigint, verdict tinyint"
ACCEPTED, REPEAT, OPEN = 1, 2, 0
#: Place of a batch's own rows, after all that is held.
NOW = (1 << 31) - 1


def settle(members: DataFrame, tolerance: float) -> DataFrame:
    """VERDICT on the rows of members that are in their own cell: accepted, repeat of (tb, tr), or open yet.

    members: hash, part, seq, b, r, mine, held, probe, fb, fr, kind, shape. A cell is a hash and part. (fb, fr) is the
    first open row of a split cell, before which nothing of the batch can change any more.
    """
    columns = ["hash", "part", "seq", "b", "r", "mine", "held", "probe", "fb", "fr", "kind", "shape"]

    def verdicts(t: pa.Table) -> pa.RecordBatch:
        v = {c: t.column(c).to_numpy() for c in columns[:-1]}
        cell = np.cumsum(np.concatenate(([False], (v["hash"][1:] != v["hash"][:-1]) | (v["part"][1:] != v["part"][:-1]))))
        best, wait = settle_cells(cell, v["mine"], v["held"], v["probe"], Outlines(t.column("shape").combine_chunks(), v["kind"].astype(np.int64), tolerance))
        ask = v["mine"] & ~v["held"]
        tb, tr = v["b"][best], v["r"][best]
        fixed = ~v["probe"] | (v["seq"][best] < NOW) | (tb < v["fb"]) | ((tb == v["fb"]) & (tr < v["fr"]))
        final = (best >= 0) & ~wait & fixed
        verdict = np.where(final, REPEAT, np.where((best < 0) & ~wait & ~v["probe"], ACCEPTED, OPEN))
        out = [v["b"], v["r"], np.where(final, tb, v["b"]), np.where(final, tr, v["r"]), verdict.astype(np.int8)]
        return pa.RecordBatch.from_arrays([pa.array(x[ask]) for x in out], names=[x.split()[0] for x in VERDICT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back = None
        for x in batches:
            t = pa.Table.from_batches([x])
            t = t if held_back is None else pa.concat_tables([held_back, t])
            if not t.num_rows:
                continue
            h, p = t.column("hash").to_numpy(), t.column("part").to_numpy()
            at = np.flatnonzero((h != h[-1]) | (p != p[-1]))
            whole = int(at[-1]) + 1 if len(at) else 0  # the last cell may go on in the next batch
            if whole:
                yield verdicts(t.slice(0, whole))
            held_back = t.slice(whole)
        if held_back is not None and held_back.num_rows:
            yield verdicts(held_back)

    return members.select(columns).repartition("hash", "part").sortWithinPartitions("hash", "part", "seq", "b", "r").mapInArrow(run, VERDICT)


class Staged:
    """Records of one or several batches, parsed once.

    copies: b, r and the first record (lb, lr) that has the same stream, within the batch if by_batch, else within all.
    firsts: the others, each once, written by batch. counts: how many of them each batch number has.
    """

    def __init__(self, features: DataFrame, work: str, tolerance: float, by_batch: bool) -> None:
        spark = features.sparkSession
        rows = parse_features(features, tolerance)
        parsed = stored(rows, f"{work}/parsed")
        key = ["b", "fp"] if by_batch else ["fp"]
        ids = parsed.groupBy("b", "r").agg(F.min("fp").alias("fp"), F.max("fp").alias("last_fp"), F.count("*").alias("n"))
        lead = parsed.groupBy(key).agg(F.min(F.struct("b", "r")).alias("lead"), F.count("*").alias("all")).filter("all > 1").select(*key, "lead")
        marked = ids.join(lead, key).filter((F.col("lead") != F.struct("b", "r")) | (F.col("n") > 1)).select("b", "r", F.col("lead.b").alias("lb"), F.col("lead.r").alias("lr"), "n")
        copies = stored(marked, f"{work}/copies")
        if not ids.filter("fp <> last_fp").isEmpty():
            raise ValueError("a row_id stands for several shapes in one batch: its repeats can't be told apart")
        if not copies.filter("n > 1").isEmpty():
            parsed = parsed.dropDuplicates(["b", "r"])
        self.copies = copies.filter("b <> lb OR r <> lr").select("b", "r", "lb", "lr")
        parsed.join(self.copies.select("b", "r"), ["b", "r"], "left_anti").select(rows.columns).write.partitionBy("b").parquet(f"{work}/firsts")
        drop(spark, f"{work}/parsed")
        self.firsts = spark.read.schema(rows.schema).parquet(f"{work}/firsts")
        self.counts = {r["b"]: r["n"] for r in self.firsts.groupBy("b").agg(F.count("*").alias("n")).collect()}

    def pairs(self, direct: DataFrame) -> DataFrame:
        """row_a, row_b: of what repeats directly, and of copies, which repeat what their first one repeats, or that one."""
        named = self.copies.join(direct.select(F.col("b").alias("lb"), F.col("r").alias("lr"), "tb", "tr"), ["lb", "lr"], "left")
        named = named.select("b", "r", F.coalesce("tb", "lb").alias("tb"), F.coalesce("tr", "lr").alias("tr"))
        return direct.unionByName(named).filter("NOT (b = tb AND r = tr)").select(F.col("tr").alias("row_a"), F.col("r").alias("row_b"))


class FeatureHistory:
    """Accepted features on disk as a chunk-to-record table; batches are checked one after another.

    index/part=<number>-<id> holds what a batch added, a row for each chunk of an accepted record (the shape stands on
    its header's), in buckets by hash. A part counts once an empty file commits/<number>-<id> names it, the last thing
    written: what a job that died left behind is never read. One writer at a time; another one's commit met meanwhile
    is an error. buckets is fixed by the first batch (default: spark.sql.shuffle.partitions).
    """

    COLUMNS = "hash BIGINT, b BIGINT, r BIGINT, nbytes INT, total INT, kind TINYINT, shape BINARY, part STRING"

    def __init__(self, path: str, tolerance: float = 0.5, buckets: int | None = None, limit: int = LIMIT) -> None:
        self.path, self.tolerance, self.buckets, self.limit = path.rstrip("/"), tolerance, buckets, limit

    def _names(self, spark: SparkSession, folder: str = "") -> list[str]:
        fs, at = hadoop_path(spark, f"{self.path}/{folder}".rstrip("/"))
        return [n for f in fs.listStatus(at) if not (n := f.getPath().getName()).startswith(".")] if fs.exists(at) else []

    def _commits(self, spark: SparkSession) -> list[str]:
        """Parts of the accepted batches in order; none only where no history is, any other failure is raised."""
        names = sorted(self._names(spark, "commits"), key=lambda n: int(n.split("-")[0]))
        if [int(n.split("-")[0]) for n in names] != list(range(len(names))):
            raise ValueError(f"the commits of {self.path} are not numbered through")
        return names

    def _touch(self, spark: SparkSession, name: str) -> None:
        fs, at = hadoop_path(spark, f"{self.path}/{name}")
        fs.create(at, False).close()

    def _name(self) -> str:
        return f"feature_history_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"

    def discard(self, spark: SparkSession) -> None:
        """Removes the history and its table."""
        spark.sql(f"DROP TABLE IF EXISTS {self._name()}")
        drop(spark, self.path)

    def table(self, spark: SparkSession) -> str:
        """The index as a table of the session's catalog, which is what knows buckets."""
        sizes = [int(n.split("-")[1]) for n in self._names(spark) if n.startswith("buckets-")]
        if not sizes:
            sizes = [self.buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))]
            self._touch(spark, f"buckets-{sizes[0]}")
        self.buckets = sizes[0]
        name = self._name()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.COLUMNS}) USING parquet PARTITIONED BY (part) CLUSTERED BY (hash) INTO {sizes[0]} BUCKETS LOCATION '{self.path}/index'")
        if spark.conf.get("spark.sql.catalogImplementation") == "hive":
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        spark.catalog.refreshTable(name)
        return name

    def accept(self, batch: DataFrame) -> DataFrame:
        """row_a, row_b of the batch's repeats; what is new is appended.

        Rows are taken by (batch_no, row_id); a null batch comes last. Batches count in the order they are accepted,
        whatever their numbers: a late one is checked against all held. A batch accepted again, whole or in part, adds
        nothing and gives the same pairs. A shape is its outline: how it is written (first corner, direction, closing
        point, further points on an edge, third coordinate, EPSG:3857 metres, a MultiPolygon of one polygon) doesn't
        matter, nor do id, crs or attributes. Null, empty or unreadable coordinates and unknown kinds of geometry
        repeat nothing. A row that comes twice (batch_no, row_id and shape) is one row; one that comes with two shapes
        is refused. Streams that share all bytes are the same shape. Only the named columns are read.
        """
        spark = batch.sparkSession
        work = scratch(spark, "batch")
        staged = Staged(batch, work, self.tolerance, by_batch=False)
        direct = direct_repeats(spark, self.add(staged.firsts, sum(staged.counts.values()), work))
        pairs = stored(staged.pairs(direct), f"{self.path}/pairs/{uuid.uuid4().hex}")
        drop(spark, work)
        return pairs

    def add(self, rows: DataFrame, size: int, work: str) -> list[str]:
        """Settles rows (about size of them, no copies among them) and adds those that repeat none; returns the folders that say which do."""
        spark = rows.sparkSession
        commits, index = self._commits(spark), self.table(spark)
        part = f"{len(commits)}-{uuid.uuid4().hex}"
        cells, rest, folders = rows, None, []
        held = spark.table(index).filter(F.col("part").isin(commits))
        if commits:
            folders.append(f"{work}/{part}-met")
            met = self._met(rows, held, size, folders[0])
            cells = rows.join(met.filter("tr IS NOT NULL").select("b", "r"), ["b", "r"], "left_anti")
            rest = met.filter("tr IS NULL").select("own", F.explode("met").alias("m")).select("own", "m.*")
        folders += self._settled(cells, rest, held, size, f"{work}/{part}")
        new = rows.join(direct_repeats(spark, folders).select("b", "r"), ["b", "r"], "left_anti")
        head = F.col("nbytes") == HEADER_BYTES
        entries = chunk_rows(new, "total", "kind", "shape").filter(~head | (F.col("hash") == F.col("own")))
        entries = entries.select("hash", "b", "r", "nbytes", "total", "kind", F.when(head, F.col("shape")).alias("shape"), F.lit(part).alias("part"))
        entries.repartition(self.buckets, "hash").write.insertInto(index)
        self._touch(spark, f"commits/{part}")
        if sum(n.split("-")[0] == str(len(commits)) for n in self._names(spark, "commits")) > 1:
            drop(spark, f"{self.path}/commits/{part}")
            raise RuntimeError(f"another job added a batch to {self.path} meanwhile: accept this one again")
        return folders

    def _met(self, rows: DataFrame, held: DataFrame, size: int, at: str) -> DataFrame:
        """What the chunk table tells of each row that shares a header with a held record (MET): with which ones, and the one it repeats if coverage decides.

        It does if all bytes are shared with the record accepted first of those met. The records met differ from one
        another and lie in a cell or four, which bounds their number, not that of the rows that meet them.
        """
        probe, known = chunk_rows(rows, "total"), held.select("hash", F.col("b").alias("mb"), F.col("r").alias("mr"), F.col("total").alias("total_m"), F.substring_index("part", "-", 1).cast("int").alias("seq"))
        hot = self._hot(rows) if size > self.limit else None
        met = probe.join(known, "hash") if hot is None else in_parts(probe, known, hot)
        head = F.when(F.col("nbytes") == HEADER_BYTES, F.col("hash"))
        of = met.groupBy("b", "r", "mb", "mr", "seq").agg(F.sum("nbytes").alias("shared"), F.max("total").alias("total"), F.max("total_m").alias("total_m"), F.max("own").alias("own"), F.max(head).alias("hash"))
        m = F.struct("seq", "mb", "mr")
        whole = F.expr("shared = total AND shared = total_m")
        best = of.filter("hash IS NOT NULL").groupBy("b", "r").agg(F.max("own").alias("own"), F.collect_list(F.struct("hash", "seq", "mb", "mr")).alias("met"), F.min(m).alias("m"), F.min(F.when(whole, m)).alias("w"))
        decided = lambda c: F.when(F.col("m") == F.col("w"), F.col(c))
        return stored(best.select("b", "r", "own", decided("m.mb").alias("tb"), decided("m.mr").alias("tr"), F.when(F.col("w").isNull() | (F.col("m") != F.col("w")), F.col("met")).alias("met")), at)

    def _hot(self, rows: DataFrame) -> DataFrame | None:
        """hash, parts of headers that more than limit rows share; None if there are none. At most rows / limit of them."""
        hot = rows.groupBy(F.col("own").alias("hash")).agg(F.count("*").alias("n")).filter(F.col("n") > self.limit).select("hash", F.ceil(F.col("n") / self.limit).cast("int").alias("parts"))
        return None if hot.isEmpty() else hot

    def _settled(self, rows: DataFrame, rest: DataFrame | None, held: DataFrame, size: int, at: str) -> list[str]:
        """The folders of the verdicts on rows, which may repeat held records (those of rest) or earlier ones of the batch."""
        cells = chunk_rows(rows).filter(F.col("nbytes") == HEADER_BYTES).select("hash", F.lit(NOW).alias("seq"), "b", "r", (F.col("hash") == F.col("own")).alias("mine"), F.col("hash").alias("listed"))
        if rest is not None:
            cells = cells.unionByName(rest.select(F.col("own").alias("hash"), "seq", F.col("mb").alias("b"), F.col("mr").alias("r"), F.lit(False).alias("mine"), F.col("hash").alias("listed")).distinct())
        crowd = cells.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
        # A row that is alone in its own cell is accepted; others may meet it all the same.
        placed = cells.join(crowd, "hash").groupBy("seq", "b", "r").agg(F.collect_list(F.struct("hash", "mine", "listed")).alias("in"), F.max("mine").alias("open"))
        left = stored(placed.select(F.explode("in").alias("c"), "seq", "b", "r", "open").select("c.hash", "seq", "b", "r", "c.mine", "c.listed", (~F.col("open")).alias("held")), f"{at}-cells-0")
        now, shapes = F.col("seq") == NOW, held.filter("shape IS NOT NULL").select(F.col("hash").alias("listed"), "b", "r", "kind", "shape")
        folders: list[str] = []
        while True:
            split = self._split(left, size)
            members = split.filter(now).join(rows.select("b", "r", "kind", "shape"), ["b", "r"])
            if rest is not None:
                members = members.unionByName(split.filter(~now).join(shapes, ["listed", "b", "r"]))
            folders.append(f"{at}-said-{len(folders)}")
            said = stored(settle(members, self.tolerance), folders[-1])
            if said.filter(F.col("verdict") == OPEN).isEmpty():
                return folders
            # What is open goes on, in the cells it lies in, with those that were accepted there.
            verdict = left.join(said.select(F.lit(NOW).alias("seq"), "b", "r", "verdict"), ["seq", "b", "r"], "left").filter(F.col("held") | (F.col("verdict") != REPEAT))
            verdict = verdict.withColumn("held", F.col("held") | (F.col("verdict") == ACCEPTED)).drop("verdict")
            open_cells = verdict.filter("mine AND NOT held").select("hash").distinct()
            left = stored(verdict.join(open_cells, "hash", "left_semi"), f"{at}-cells-{len(folders)}")

    def _split(self, left: DataFrame, size: int) -> DataFrame:
        """left with part, probe and first open row: cells of more than limit open rows in parts.

        Part 0 has about the first limit open rows, the other parts the rest as probes; all have the accepted rows.
        """
        whole = [F.lit(0).alias("part"), F.lit(False).alias("probe"), F.lit(0).cast("bigint").alias("fb"), F.lit(0).cast("bigint").alias("fr")]
        if size <= self.limit:
            return left.select("*", *whole)
        big = left.filter("NOT held").groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("b", "r")).alias("f")).filter(F.col("n") > self.limit)
        if big.isEmpty():
            return left.select("*", *whole)
        big = F.broadcast(big)  # at most rows / limit of them
        shares = [2.0**-i for i in range(13)]
        firsts = left.filter("NOT held").join(big, "hash").filter("b = f.b").groupBy("hash").agg(F.percentile_approx("r", shares, 10_000).alias("q"), F.count("*").alias("n0"))
        step = F.least(F.greatest(F.ceil(F.log2(F.col("n0") / self.limit)), F.lit(0)), F.lit(12)).cast("int")
        firsts = F.broadcast(firsts.select("hash", F.get("q", step).alias("until")))
        cut = left.join(big, "hash").join(firsts, "hash").withColumn("parts", F.ceil(F.col("n") / self.limit).cast("int"))
        first = F.expr("b = f.b AND r <= until")
        part = F.when(F.col("held"), F.sequence(F.lit(0), F.col("parts"))).when(first, F.array(F.lit(0))).otherwise(F.array((F.pmod(F.xxhash64("b", "r"), F.col("parts")) + 1).cast("int")))
        cut = cut.select(*left.columns, F.explode(part).alias("part"), (~F.col("held") & ~first).alias("probe"), F.col("f.b").alias("fb"), F.col("f.r").alias("fr"))
        return left.join(big.select("hash"), "hash", "left_anti").select("*", *whole).unionByName(cut)


MET = "b bigint, r bigint, own bigint, tb bigint, tr bigint, met array<struct<hash: bigint, seq: int, mb: bigint, mr: bigint>>"


def direct_repeats(spark: SparkSession, folders: list[str]) -> DataFrame:
    """b, r, tb, tr of what repeats a record, as the folders of one batch or several tell."""
    said, met = ([f for f in folders if f.endswith("-met") == kind] for kind in (False, True))
    out = spark.read.schema(VERDICT).parquet(*said).filter(F.col("verdict") == REPEAT).drop("verdict")
    return out.unionByName(spark.read.schema(MET).parquet(*met).filter("tr IS NOT NULL").select("b", "r", "tb", "tr")) if met else out


def in_parts(probe: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """probe joined with known by hash, the hot hashes' probes dealt to parts that each meet all of known."""
    hot = F.broadcast(hot)
    usual = probe.join(hot.select("hash"), "hash", "left_anti").join(known, "hash")
    dealt = probe.join(hot, "hash").withColumn("part", F.pmod(F.xxhash64("b", "r"), F.col("parts")).cast("int")).drop("parts")
    copied = known.join(hot, "hash").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return usual.unionByName(dealt.join(copied, ["hash", "part"]).drop("part"))


#: Bytes of parsed records to a bucket, and most buckets, of the history that repeats() builds.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4096


def repeats(features: DataFrame, tolerance: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """row_a, row_b: each feature that repeats an accepted one, with the earliest it repeats.

    Batch after batch, by batch_no, through a history of its own; all are parsed and written by batch beforehand. See
    FeatureHistory.accept for what counts as a repeat.
    """
    spark = features.sparkSession
    at = scratch(spark, "history")
    staged = Staged(features, at, tolerance, by_batch=True)
    fs, firsts = hadoop_path(spark, f"{at}/firsts")
    history = FeatureHistory(f"{at}/accepted", tolerance, max(1, min(MOST_BUCKETS, -(-fs.getContentSummary(firsts).getLength() // BUCKET_BYTES))), limit)
    folders: list[str] = []
    for number in sorted(staged.counts):
        folders += history.add(staged.firsts.filter(F.col("b") == number), staged.counts[number], at)
    if not folders:
        return spark.createDataFrame([], "row_a bigint, row_b bigint")
    pairs = stored(staged.pairs(direct_repeats(spark, folders)), f"{at}/pairs")
    history.discard(spark)
    drop(spark, f"{at}/firsts")
    return pairs
