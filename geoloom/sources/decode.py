"""Small decoders for tile formats: elevation PNG, vector tiles, tile archives. Bytes in, plain values out."""

from __future__ import annotations

import gzip
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- PNG ------------------------------------------------------------------------------------------------------------


def read_png(data: bytes) -> np.ndarray:
    """height x width x channels of an 8-bit, non-interlaced grey, RGB, palette or RGBA image."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, b"", b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None:
        raise ValueError("a PNG without a header")
    width, height, depth, colour, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or laced or channels is None:
        raise ValueError("only 8-bit images that aren't interlaced")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        f, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        if f == 2:
            row = row + above
        elif f in (1, 3, 4):
            for x in range(len(row)):
                a = row[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if f == 1:
                    add = a
                elif f == 3:
                    add = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                row[x] = (row[x] + add) & 255
        above = row & 255
        out[y] = above
    img = out.reshape(height, width, channels)
    return np.frombuffer(palette, np.uint8).reshape(-1, 3)[img[:, :, 0]] if colour == 3 else img


def elevation_tiles(files: DataFrame) -> DataFrame:
    """z, x, y, width, height, dem, error from columns z, x, y and content (PNG bytes); bad images give an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    p = read_png(r["content"] or b"")[:, :, :3].astype(float)
                    dem = -10000.0 + (p[:, :, 0] * 65536.0 + p[:, :, 1] * 256.0 + p[:, :, 2]) * 0.1
                    rows.append((r["z"], r["x"], r["y"], p.shape[1], p.shape[0], dem.ravel(), None))
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    rows.append((r["z"], r["x"], r["y"], None, None, None, str(e)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["z", "x", "y", "width", "height", "dem", "error"])

    return files.selectExpr("cast(z as int) z", "cast(x as bigint) x", "cast(y as bigint) y", "content").mapInArrow(run, "z int, x bigint, y bigint, width int, height int, dem array<double>, error string")


# --- protocol buffers and vector tiles ---------------------------------------------------------------------------------


def varint(b: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        x = b[at]
        at += 1
        v |= (x & 127) << shift
        if x < 128:
            return v, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            v, at = varint(b, at)
        elif kind == 1:
            v, at = b[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(b, at)
            if at + n > len(b):
                raise ValueError("cut off")
            v, at = b[at : at + n], at + n
        elif kind == 5:
            v, at = b[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, v


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(v)
    return out


def _value(b: bytes) -> object:
    for n, _, v in fields(b):
        if n == 1:
            return v.decode("utf-8", "replace")
        if n == 2:
            return struct.unpack("<f", v)[0]
        if n == 3:
            return struct.unpack("<d", v)[0]
        if n in (4, 5):
            return v - (1 << 64) if v >= 1 << 63 else v
        if n == 6:
            return signed(v)
        if n == 7:
            return bool(v)
    return None


def _paths(commands: list[int]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == 7:
            if out and out[-1]:
                out[-1].append(out[-1][0])
            continue
        for _ in range(n):
            x, y = x + signed(commands[at]), y + signed(commands[at + 1])
            at += 2
            if op == 1:
                out.append([])
            out[-1].append((x, y))
    return out


def read_vector_tile(data: bytes, z: int, x: int, y: int) -> Iterator[dict]:
    """Features of all layers as layer, index, id, properties, geometry_type and coordinates in degrees."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for n, _, layer in fields(data):
        if n != 3:
            continue
        name, keys, values, raw, extent = "", [], [], [], 4096
        for k, _, v in fields(layer):
            if k == 1:
                name = v.decode("utf-8", "replace")
            elif k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif k == 4:
                values.append(_value(v))
            elif k == 5:
                extent = v
        size = extent * 2.0**z

        def degrees(p: tuple[int, int], size: float = size, extent: int = extent) -> list[float]:
            t = 180.0 - (p[1] + extent * y) * 360.0 / size
            return [(p[0] + extent * x) * 360.0 / size - 180.0, 360.0 / math.pi * math.atan(math.exp(math.radians(t))) - 90.0]

        for index, f in enumerate(raw):
            fid, tags, kind, commands = None, [], 0, []
            for k, _, v in fields(f):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = packed(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = packed(v)
            paths = _paths(commands)
            deg = lambda path: [degrees(p) for p in path]
            if kind == 1:
                pts = [q for p in paths for q in deg(p)]
                geometry, coords = ("Point", pts[0]) if len(pts) == 1 else ("MultiPoint", pts)
            elif kind == 2:
                geometry, coords = ("LineString", deg(paths[0])) if len(paths) == 1 else ("MultiLineString", [deg(p) for p in paths])
            else:
                polygons: list[list] = []
                outer = 0.0
                for p in paths:
                    a = sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:], strict=False))
                    if a == 0:
                        continue
                    outer = outer or a
                    if (a > 0) == (outer > 0) or not polygons:
                        polygons.append([])
                    polygons[-1].append(deg(p))
                geometry, coords = ("Polygon", polygons[0]) if len(polygons) == 1 else ("MultiPolygon", polygons)
            yield {"layer": name, "index": index, "id": fid, "properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=False)}, "geometry_type": geometry, "coordinates": coords}


def vector_features(tiles: DataFrame) -> DataFrame:
    """Features of vector tiles given as z, x, y, content; properties and coordinates come as JSON text."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    got = list(read_vector_tile(r["content"] or b"", r["z"], r["x"], r["y"]))
                    rows += [(r["z"], r["x"], r["y"], f["layer"], f["index"], None if f["id"] is None else str(f["id"]), json.dumps(f["properties"]), f["geometry_type"], json.dumps(f["coordinates"]), None) for f in got]
                except (ValueError, IndexError, struct.error, OSError, zlib.error) as e:
                    rows.append((r["z"], r["x"], r["y"], None, None, None, None, None, None, str(e) or "cut off"))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["z", "x", "y", "layer", "index", "id", "properties", "geometry_type", "coordinates", "error"])

    return tiles.selectExpr("cast(z as int) z", "cast(x as bigint) x", "cast(y as bigint) y", "content").mapInArrow(run, "z int, x bigint, y bigint, layer string, index int, id string, properties string, geometry_type string, coordinates string, error string")


# --- tile archives -------------------------------------------------------------------------------------------------------


def archive_id(z: int, x: int, y: int) -> int:
    """Place of a tile along the Hilbert curves of all zooms."""
    base = (4**z - 1) // 3
    d, s = 0, (1 << z) >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        s >>= 1
    return base + d


class Archive:
    """A PMTiles (version 3) archive on a file that can seek; read(offset, n) may as well be a range request."""

    def __init__(self, read) -> None:
        self.read = read
        h = read(0, 127)
        if h[:7] != b"PMTiles" or h[7] != 3:
            raise ValueError("not a PMTiles archive of version 3")
        self.root, self.root_n, _, _, self.leaves, _, self.data, _ = struct.unpack("<8Q", h[8:72])
        self.inner, self.packing = h[97], h[98]

    def _open(self, b: bytes, how: int) -> bytes:
        if how in (0, 1):
            return b
        if how == 2:
            return gzip.decompress(b)
        raise ValueError(f"compression {how}")

    def _entries(self, offset: int, n: int) -> list[tuple[int, int, int, int]]:
        v = packed(self._open(self.read(offset, n), self.inner))
        k = v[0]
        ids = list(np.cumsum(v[1 : 1 + k]))
        runs, sizes, places = v[1 + k : 1 + 2 * k], v[1 + 2 * k : 1 + 3 * k], v[1 + 3 * k : 1 + 4 * k]
        out, last = [], 0
        for i in range(k):
            at = last if places[i] == 0 and i else places[i] - 1
            out.append((int(ids[i]), runs[i], sizes[i], at))
            last = at + sizes[i]
        return out

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        want, offset, n = archive_id(z, x, y), self.root, self.root_n
        for _ in range(4):
            found = [e for e in self._entries(offset, n) if e[0] <= want]
            if not found:
                return None
            start, run, size, at = found[-1]
            if run:
                return self._open(self.read(self.data + at, size), self.packing) if want < start + run else None
            offset, n = self.leaves + at, size
        return None


def archive_tiles(tiles: DataFrame, archive: str) -> DataFrame:
    """z, x, y and content of tiles (z, x, y) from an archive at an address all executors reach; absent ones are left out.

    Tiles are dealt out by their place in the archive, so that neighbours are read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(archive)
        with files.open_input_file(path) as f:
            a = Archive(lambda at, n: f.read_at(n, at))
            for b in batches:
                keys = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                got = [(k, v) for k in sorted(keys, key=lambda k: archive_id(*k)) if (v := a.tile(*k)) is not None]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))), pa.array([v for _, v in got], pa.binary())], names=["z", "x", "y", "content"])

    wanted = tiles.selectExpr("cast(z as int) z", "cast(x as bigint) x", "cast(y as bigint) y").dropna().distinct()
    return wanted.mapInArrow(run, "z int, x bigint, y bigint, content binary")


def archive_features(tiles: DataFrame, archive: str) -> DataFrame:
    """Features of an archive's vector tiles; see vector_features."""
    return vector_features(archive_tiles(tiles, archive))
