"""Points near other points, and the regions that contain them.

Space is cut into the leaves of a quadtree laid out from a bounded sample of distinct positions; only the layout
depends on the sample. Each position goes to its own leaf and, where its search window crosses the border, to the
neighbouring leaves; a region goes to every leaf its box touches. Within a leaf a packed R-tree is bulk loaded and
probed, distances and containment are computed exactly, and a pair is reported only in the leaf that owns the
smaller of the two positions. Rows at one position are worked on once and expanded at the end, in chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371008.8
BITS = 24


class QuadTree:
    """Leaves over the lon/lat plane as ranges of Morton codes."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, per_leaf: int, least_deg: float) -> None:
        codes = np.sort(morton(*cells(lon, lat)))
        deepest = max(1, min(BITS, int(np.floor(np.log2(180.0 / max(least_deg, 1e-9))))))
        starts: list[int] = []
        todo = [(0, 0, 0, len(codes))]
        while todo:
            start, depth, lo, hi = todo.pop()
            if hi - lo <= per_leaf or depth >= deepest:
                starts.append(start)
                continue
            step = 1 << (2 * (BITS - depth - 1))
            edges = lo + np.searchsorted(codes[lo:hi], [start + step * k for k in range(5)])
            edges[0], edges[4] = lo, hi
            todo += [(start + step * k, depth + 1, edges[k], edges[k + 1]) for k in range(4)]
        self.starts = np.sort(np.array(starts, dtype=np.int64))
        self.width = np.diff(np.append(self.starts, 1 << (2 * BITS)))

    def leaf_of(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(*cells(lon, lat)), side="right") - 1

    def leaves_of_boxes(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of box, leaf) of all leaves each box touches; boxes lie within the plane."""
        corner = [self.leaf_of(x, y) for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
        one = (corner[0] == corner[1]) & (corner[0] == corner[2]) & (corner[0] == corner[3])
        box, leaf = [np.flatnonzero(one)], [corner[0][one]]
        rest = np.flatnonzero(~one)
        if len(rest):
            (cx0, cy0), (cx1, cy1) = cells(x0[rest], y0[rest]), cells(x1[rest], y1[rest])
            # Leaves are squares of cells: walk down from the whole plane, all boxes at once.
            who, start, depth = np.arange(len(rest)), np.zeros(len(rest), np.int64), 0
            while len(who):
                at = np.searchsorted(self.starts, start, side="right") - 1
                size = 1 << (2 * (BITS - depth))
                done = self.width[at] >= size
                box.append(rest[who[done]])
                leaf.append(at[done])
                who, start, depth = who[~done], start[~done], depth + 1
                if not len(who):
                    break
                step = 1 << (2 * (BITS - depth))
                who, start = np.repeat(who, 4), (start[:, None] + step * np.arange(4)).ravel()
                sx, sy = unmorton(start)
                side = 1 << (BITS - depth)
                hit = (sx <= cx1[who]) & (sx + side > cx0[who]) & (sy <= cy1[who]) & (sy + side > cy0[who])
                who, start = who[hit], start[hit]
        return np.concatenate(box), np.concatenate(leaf)


def cells(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << BITS
    to = lambda v: np.clip((v * n).astype(np.int64), 0, n - 1)
    return to((np.asarray(lon) + 180.0) / 360.0), to((np.asarray(lat) + 90.0) / 180.0)


SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def spread(v: np.ndarray) -> np.ndarray:
        for s, m in SPREAD:
            v = (v | (v << s)) & m
        return v

    return spread(x) | (spread(y) << 1)


def unmorton(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def gather(v: np.ndarray) -> np.ndarray:
        v = v & SPREAD[-1][1]
        for (s, _), m in zip(reversed(SPREAD), [SPREAD[3][1], SPREAD[2][1], SPREAD[1][1], SPREAD[0][1], 0xFFFFFFFF], strict=True):
            v = (v | (v >> s)) & m
        return v

    return gather(code), gather(code >> 1)


class PackedRTree:
    """Sort-tile-recursive bulk load over boxes; probed with many boxes at once."""

    NODE = 16

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> None:
        n = len(x0)
        slabs = max(1, int(np.ceil(np.sqrt(n / self.NODE))))
        by_x = np.argsort(x0 + x1, kind="stable")
        slab = np.empty(n, np.int64)
        slab[by_x] = np.arange(n) * slabs // max(n, 1)
        self.order = np.lexsort((y0 + y1, slab))
        level = np.stack([x0, y0, x1, y1])[:, self.order]
        self.levels = [level]
        while level.shape[1] > 1:
            first = np.arange(0, level.shape[1], self.NODE)
            level = np.stack([np.minimum.reduceat(level[0], first), np.minimum.reduceat(level[1], first), np.maximum.reduceat(level[2], first), np.maximum.reduceat(level[3], first)])
            self.levels.append(level)

    def probe(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the probe, index of the box) of all that touch."""
        if not self.levels[0].shape[1] or not len(x0):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, node = np.arange(len(x0)), np.zeros(len(x0), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            b = self.levels[k]
            hit = (b[0, node] <= x1[q]) & (b[2, node] >= x0[q]) & (b[1, node] <= y1[q]) & (b[3, node] >= y0[q])
            q, node = q[hit], node[hit]
            if k:
                q, node = np.repeat(q, self.NODE), (node[:, None] * self.NODE + np.arange(self.NODE)).ravel()
                fits = node < self.levels[k - 1].shape[1]
                q, node = q[fits], node[fits]
        return q, self.order[node]


def ground_m(lon_a: np.ndarray, lat_a: np.ndarray, lon_b: np.ndarray, lat_b: np.ndarray) -> np.ndarray:
    """Great-circle distance in metres (haversine, exact for small distances)."""
    a, b = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def window_deg(lat: np.ndarray, metres: float) -> tuple[np.ndarray, float]:
    """Half width and half height, in degrees, of a box that holds all points within metres."""
    dlat = np.degrees(metres / EARTH_M) * 1.001
    reach = np.minimum(np.abs(lat) + dlat, 90.0)
    s = np.sin(np.radians(dlat)) / np.maximum(np.cos(np.radians(reach)), 1e-12)
    return np.where(s >= 1, 360.0, np.degrees(np.arcsin(np.minimum(s, 1))) * 1.001), dlat


def zone_rings(geometry: str | None) -> list[np.ndarray]:
    """All rings of a Polygon or MultiPolygon given as JSON; rings across the 180° meridian are unrolled."""
    try:
        v = json.loads(geometry or "null")
    except (ValueError, RecursionError):
        return []
    rings: list[np.ndarray] = []

    def collect(x: object) -> None:
        if isinstance(x, list) and x and isinstance(x[0], list):
            if x[0] and isinstance(x[0][0], (int, float)):
                r = np.array([p[:2] for p in x if isinstance(p, list) and len(p) >= 2], float)
                if len(r) >= 3:
                    if r[:, 0].max() - r[:, 0].min() > 180:
                        r[:, 0] = np.where(r[:, 0] < 0, r[:, 0] + 360, r[:, 0])
                    rings.append(r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]))
            else:
                for y in x:
                    collect(y)

    collect(v)
    return rings


def inside(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings: holes are outside, parts of a MultiPolygon count together."""
    odd = np.zeros(len(x), bool)
    for r in rings:
        xa, ya, xb, yb = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        for at in range(0, len(x), 65536):
            px, py = x[at : at + 65536, None], y[at : at + 65536, None]
            cross = (ya > py) != (yb > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd[at : at + 65536] ^= (np.sum(cross & (px < (xb - xa) * (py - ya) / (yb - ya) + xa), axis=1) % 2).astype(bool)
    return odd


def boxes_in_plane(x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
    """Parts of longitude ranges that lie in [-180, 180], with the shift that brings them there."""
    for shift in (0.0, 360.0, -360.0):
        a, b = x0 + shift, x1 + shift
        hit = (b >= -180) & (a <= 180)
        yield np.flatnonzero(hit), shift, np.maximum(a[hit], -180), np.minimum(b[hit], 180)


def valid_positions(points: DataFrame, point_id: str, lat: str, lon: str) -> DataFrame:
    """point_id, lat, lon of rows with a possible position; null, NaN and out-of-range ones are no cases."""
    p = points.select(F.col(point_id).cast("bigint").alias("point_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return p.filter("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND point_id IS NOT NULL")


def layout(points: DataFrame, metres: float, sample: int, per_leaf: int) -> tuple[QuadTree, int]:
    """Quadtree from at most about sample distinct positions, and the number of points."""
    total = points.count()
    share = min(1.0, sample / max(total, 1))
    picked = points.filter(F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 30)) < int(share * (1 << 30))).select("lat", "lon").distinct()
    rows = picked.toPandas()
    weight = total / max(len(rows), 1) if share < 1 else 1.0
    _, dlat = window_deg(np.zeros(1), metres)
    return QuadTree(rows["lon"].to_numpy(float), rows["lat"].to_numpy(float), max(8, int(per_leaf / max(weight, 1e-9))), 2 * dlat), total


def position_joins(points: DataFrame, zones: DataFrame, metres: float, point_id: str, lat: str, lon: str, zone_id: str, sample: int, per_leaf: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct positions joined: (chunks of point ids by position, positions with their number of points, found).

    found has lat_a, lon_a with lat_b, lon_b of another position near it, or with a zone it is in.
    """
    own = valid_positions(points, point_id, lat, lon)
    tree, total = layout(own, metres, sample, per_leaf)
    # A hot position is kept in chunks; their number follows the table, so that each stays of bounded size.
    salts = max(16, total // 4096)
    chunks = own.groupBy("lat", "lon", F.pmod(F.xxhash64("point_id"), F.lit(salts)).alias("salt")).agg(F.collect_set("point_id").alias("ids"))
    positions = chunks.groupBy("lat", "lon").agg(F.sum(F.size("ids")).alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            dlon, dlat = window_deg(y, metres)
            home = tree.leaf_of(x, y)
            at, leaf, sx = [np.arange(len(x))], [home], [x]
            y0, y1 = np.maximum(y - dlat, -90), np.minimum(y + dlat, 90)
            for who, shift, a, c in boxes_in_plane(np.maximum(x - dlon, -360), np.minimum(x + dlon, 360)):
                k, l = tree.leaves_of_boxes(a, y0[who], c, y1[who])
                k = who[k]
                other = (l != home[k]) | (shift != 0)
                at.append(k[other])
                leaf.append(l[other])
                sx.append(x[k[other]] + shift)
            at, leaf, sx = np.concatenate(at), np.concatenate(leaf), np.concatenate(sx)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(np.arange(len(at)) < len(x)), pa.array(y[at]), pa.array(x[at]), pa.array(sx), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string())], names=PLACED)

    def place_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, leaf = [], []
            for i, t in enumerate(texts):
                rings = zone_rings(t)
                if not rings or ids[i] is None:
                    continue
                r = np.vstack(rings)
                for _, _, x0, x1 in boxes_in_plane(r[:1, 0] * 0 + r[:, 0].min(), r[:1, 0] * 0 + r[:, 0].max()):
                    if len(x0):
                        _, l = tree.leaves_of_boxes(x0, np.maximum(r[:, 1].min(), -90)[None], x1, np.minimum(r[:, 1].max(), 90)[None])
                        leaf += l.tolist()
                        at += [i] * len(l)
            keep = dict.fromkeys(zip(at, leaf, strict=True))
            n = len(keep)
            none = pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in keep], pa.int64()), pa.array([False] * n), none, none, none, pa.array([ids[k[0]] for k in keep], pa.int64()), pa.array([texts[k[0]] for k in keep], pa.string())], names=PLACED)

    placed = positions.select("lat", "lon").mapInArrow(place, PLACED_SCHEMA)
    placed_zones = zones.select(F.col(zone_id).cast("bigint").alias("zone"), F.col("coordinates").cast("string").alias("geometry")).mapInArrow(place_zones, PLACED_SCHEMA)

    def within_leaf(f: pd.DataFrame) -> pd.DataFrame:
        z = f["zone"].notna().to_numpy()
        p = f[~z]
        mine = p["own"].to_numpy(bool)
        y, x, true_x = (p[c].to_numpy(float) for c in ("lat", "sx", "lon"))
        out = []
        if mine.any():
            dlon, dlat = window_deg(y[mine], metres)
            me = np.flatnonzero(mine)
            q, o = PackedRTree(x, y, x, y).probe(x[me] - dlon, y[me] - dlat, x[me] + dlon, y[me] + dlat)
            a = me[q]
            # Reported by the owner of the smaller position only: that one is in exactly one leaf.
            first = (y[a] < y[o]) | ((y[a] == y[o]) & (true_x[a] < true_x[o]))
            a, o = a[first], o[first]
            near = ground_m(x[a], y[a], x[o], y[o]) <= metres
            a, o = a[near], o[near]
            got = pd.DataFrame({"lat_a": y[a], "lon_a": true_x[a], "lat_b": y[o], "lon_b": true_x[o], "zone": pd.array([None] * len(a), "Int64")})
            out.append(got.drop_duplicates())
            zs = f[z]
            if len(zs):
                shapes = [zone_rings(t) for t in zs["geometry"]]
                box = np.array([[r[:, 0].min(), r[:, 1].min(), r[:, 0].max(), r[:, 1].max()] for r in (np.vstack(s) for s in shapes)]).T
                rt, ids = PackedRTree(*box), zs["zone"].to_numpy()
                for shift in (0.0, 360.0, -360.0):
                    xs = x[me] + shift
                    q, o = rt.probe(xs, y[me], xs, y[me])
                    for k in np.unique(o):
                        c = q[o == k]
                        c = c[inside(shapes[k], xs[c], y[me[c]])]
                        out.append(pd.DataFrame({"lat_a": y[me[c]], "lon_a": true_x[me[c]], "lat_b": np.nan, "lon_b": np.nan, "zone": pd.array([int(ids[k])] * len(c), "Int64")}))
        out = [o for o in out if len(o)]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("lat_a", float), ("lon_a", float), ("lat_b", float), ("lon_b", float), ("zone", "Int64"))})

    found = placed.unionByName(placed_zones).groupBy("leaf").applyInPandas(within_leaf, "lat_a double, lon_a double, lat_b double, lon_b double, zone bigint")
    return chunks, positions, found


def point_joins(points: DataFrame, zones: DataFrame, metres: float = 30.0, point_id: str = "point_id", lat: str = "latitude", lon: str = "longitude", zone_id: str = "zone_id", sample: int = 40_000, per_leaf: int = 4_000) -> DataFrame:
    """kind, key_a, key_b: 'near' pairs of points at most metres apart (key_a < key_b), 'inside' point and zone.

    Points without a possible position and zones without a readable polygon take no part. Points at one position
    are near one another; a repeated row (same id) is no partner of itself. Ties at exactly metres count. An empty
    table gives no rows. Only the named columns are read, so other names cannot clash.
    """
    chunks, positions, found = position_joins(points, zones, metres, point_id, lat, lon, zone_id, sample, per_leaf)
    side = lambda s: chunks.select(F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("salt").alias(f"salt_{s}"), F.col("ids").alias(f"ids_{s}"))
    same = positions.filter("n > 1").select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.lit(None).cast("bigint").alias("zone"))
    a = found.unionByName(same).join(side("a"), ["lat_a", "lon_a"])
    at_one = "(lat_a = lat_b AND lon_a = lon_b)"
    met = a.filter("zone IS NULL").join(side("b"), ["lat_b", "lon_b"]).filter(f"NOT {at_one} OR salt_a <= salt_b")
    # The chunks of a hot position meet in many rows: spread them before the ids are paired.
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = met.repartition(width, "lat_a", "lon_a", "salt_a", "salt_b").select("ids_a", "ids_b", F.expr(f"{at_one} AND salt_a = salt_b").alias("alike"))
    near = spread.select(F.explode("ids_a").alias("a"), "ids_b", "alike").select("a", F.explode("ids_b").alias("b"), "alike").filter("a <> b AND (NOT alike OR a < b)").select(F.lit("near").alias("kind"), F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
    contained = a.filter("zone IS NOT NULL").select(F.lit("inside").alias("kind"), F.explode("ids_a").alias("key_a"), F.col("zone").alias("key_b"))
    return near.unionByName(contained)



def class_joins(points: DataFrame, zones: DataFrame, metres: float = 30.0, point_id: str = "point_id", lat: str = "latitude", lon: str = "longitude", zone_id: str = "zone_id", sample: int = 40_000, per_leaf: int = 4_000) -> DataFrame:
    """point_joins without the pairs within and between groups of points at one position.

    A position is known by its smallest point id, its class. kind 'member': each point and its class; 'near': two
    classes near each other (key_a < key_b); 'inside': a class and a zone. A position with a third of all points
    gives one row a point, not their pairs.
    """
    chunks, _, found = position_joins(points, zones, metres, point_id, lat, lon, zone_id, sample, per_leaf)
    classes = chunks.groupBy("lat", "lon").agg(F.min(F.array_min("ids")).alias("class"))
    member = chunks.join(classes, ["lat", "lon"]).select(F.lit("member").alias("kind"), F.explode("ids").alias("key_a"), F.col("class").alias("key_b"))
    named = lambda k: classes.select(F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"), F.col("class").alias(f"class_{k}"))
    a = found.join(named("a"), ["lat_a", "lon_a"])
    near = a.filter("zone IS NULL").join(named("b"), ["lat_b", "lon_b"]).select(F.lit("near").alias("kind"), F.least("class_a", "class_b").alias("key_a"), F.greatest("class_a", "class_b").alias("key_b"))
    inside_of = a.filter("zone IS NOT NULL").select(F.lit("inside").alias("kind"), F.col("class_a").alias("key_a"), F.col("zone").alias("key_b"))
    return member.unionByName(near).unionByName(inside_of)


PLACED = ["leaf", "own", "lat", "lon", "sx", "zone", "geometry"]
PLACED_SCHEMA = "leaf bigint, own boolean, lat double, lon double, sx double, zone bigint, geometry string"
