import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from geoloom import sinks
from geoloom.sources import decode, files, urls, wfs


def png(width, height, pixels, filters):
    raw = b""
    above = bytes(3 * width)
    for y in range(height):
        row = bytes(v for p in pixels[y * width : (y + 1) * width] for v in p)
        f, out = filters[y], []
        for i, v in enumerate(row):
            a, b, c = row[i - 3] if i >= 3 else 0, above[i], above[i - 3] if i >= 3 else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = [0, a, b, (a + b) // 2, a if pa <= pb and pa <= pc else b if pb <= pc else c][f]
            out.append((v - guess) & 255)
        raw += bytes([f, *out])
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_elevation_images(spark):
    px = [((i * 7) % 5, (i * 31) % 256, (i * 17) % 256) for i in range(20)]
    data = png(4, 5, px, [0, 1, 2, 3, 4])
    assert decode.read_png(data).reshape(-1, 3).tolist() == [list(p) for p in px]
    df = spark.createDataFrame([(12, 1, 2, bytearray(data)), (12, 1, 3, bytearray(b"no")), (12, 1, 4, None)], "z int, x long, y long, content binary")
    got = {r["y"]: r for r in decode.elevation_tiles(df).collect()}
    assert got[2]["dem"] == [-10000 + (r * 65536.0 + g * 256.0 + b) * 0.1 for r, g, b in px] and got[3]["error"] and got[4]["dem"] is None


def vint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def msg(n, b):
    return vint(n << 3 | 2) + vint(len(b)) + b


def zz(v):
    return vint((v << 1) ^ (v >> 63) if v < 0 else v << 1)


def layer(name, fs):
    body = msg(1, name.encode())
    for fid, kind, cmds in fs:
        body += msg(2, vint(1 << 3) + vint(fid) + msg(2, vint(0) + vint(0)) + vint(3 << 3) + vint(kind) + msg(4, cmds))
    return msg(3, body + msg(3, b"has_parts") + msg(4, vint(7 << 3) + vint(1)) + vint(5 << 3) + vint(4096))


SQUARE = vint(9) + zz(0) + zz(0) + vint(3 << 3 | 2) + zz(4096) + zz(0) + zz(0) + zz(4096) + zz(-4096) + zz(0) + vint(15)


def test_vector_tiles(spark):
    tile = layer("building", [(7, 3, SQUARE), (8, 1, vint(9) + zz(2048) + zz(2048))])
    got = list(decode.read_vector_tile(tile, 1, 1, 0))
    assert [(f["id"], f["geometry_type"], f["properties"]) for f in got] == [(7, "Polygon", {"has_parts": True}), (8, "Point", {"has_parts": True})]
    assert got[0]["coordinates"][0][0] == [0.0, pytest.approx(85.0511287798)] and got[0]["coordinates"][0][2] == [180.0, pytest.approx(0.0)]
    df = spark.createDataFrame([(1, 1, 0, bytearray(tile)), (1, 0, 0, bytearray(tile[:9])), (1, 0, 1, None)], "z int, x long, y long, content binary")
    rows = decode.vector_features(df).collect()
    assert sorted((r["id"] or "", bool(r["error"])) for r in rows) == [("", True), ("7", False), ("8", False)]


def test_archives():
    tiles = {(0, 0, 0): b"root", (1, 1, 0): b"east"}
    entries = sorted((decode.archive_id(*k), v) for k, v in tiles.items())
    data = b"".join(v for _, v in entries)
    ids = [e[0] for e in entries]
    d = vint(2) + vint(ids[0]) + vint(ids[1] - ids[0]) + vint(1) + vint(1) + vint(4) + vint(4) + vint(1) + vint(0)
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(d), 0, 0, 127 + len(d), 0, 127 + len(d), len(data), 2, 2, 2) + bytes([1, 1, 1, 1, 0, 1])
    blob = head.ljust(127, b"\0") + d + data
    a = decode.Archive(lambda at, n: blob[at : at + n])
    assert {k: a.tile(*k) for k in [*tiles, (1, 0, 0)]} == tiles | {(1, 0, 0): None}
    assert [decode.archive_id(1, *p) for p in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]


def test_archives_as_a_table(spark, tmp_path):
    tile = layer("building", [(7, 3, SQUARE)])
    place = decode.archive_id(1, 1, 0)
    d = vint(1) + vint(place) + vint(1) + vint(len(tile)) + vint(1)
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(d), 0, 0, 127 + len(d), 0, 127 + len(d), len(tile), 1, 1, 1) + bytes([1, 1, 1, 1, 0, 1])
    (tmp_path / "a.pmtiles").write_bytes(head.ljust(127, b"\0") + d + tile)
    wanted = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 1)], "z int, x long, y long")
    got = decode.archive_features(wanted, str(tmp_path / "a.pmtiles")).collect()
    assert [(r["z"], r["x"], r["y"], r["id"], r["geometry_type"]) for r in got] == [(1, 1, 0, "7", "Polygon")]
    with pytest.raises(ValueError):
        urls.newest_release("<List/>")
    assert urls.newest_release("<Prefix>tiles/2026-06-17.0/</Prefix><Prefix>tiles/2026-07-22.0/</Prefix>") == "2026-07-22.0"


def test_features_of_a_table_of_requests(spark, tmp_path):
    a = "https://w.example/ows?l=a"
    (tmp_path / "index.json").write_text(json.dumps(service(tmp_path, a, 5, 2)))
    ask = spark.createDataFrame([("t1", a), ("t2", a), ("t3", "https://w.example/none"), (None, None)], "tile string, url string")
    got = wfs.fetch_features(ask, wfs.folder_fetch(str(tmp_path)), 2, retries=0)
    assert sorted((r["tile"], json.loads(r["feature"])["id"]) for r in got.collect() if r["feature"]) == [("t1", i) for i in range(5)]
    assert [(r["tile"], r["error"]) for r in got.collect() if r["error"]] == [("t3", "HTTP 404")]
    assert wfs.complete(got).count() == 5
    # Asked once, 204 and 404 are no features; no answer is an error row, not a dead job.
    assert list(wfs.pages("https://w.example/x", None, lambda u: (404, "")))[0][1:] == (404, [], None)
    assert wfs.http("http://127.0.0.1:9/none")[0] == 0 and wfs.http("nonsense")[0] == 0
    assert wfs.fetch_features(ask.limit(1), wfs.http, None, retries=0).filter("error LIKE 'no answer%'").count() in (0, 1)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "response.json").write_text('{"features": [1]}')
    assert wfs.folder_fetch(str(tmp_path / "one"))("any") == (200, '{"features": [1]}')


def test_addresses(spark):
    assert urls.with_page("https://w.example/ows?a=1&count=9", 2, 4) == "https://w.example/ows?a=1&count=2&startIndex=4"
    assert urls.with_page("ows", 2, 0) == "ows?count=2&startIndex=0" and urls.with_page("ows?a=1", 2, 0) == "ows?a=1&count=2&startIndex=0"
    for bad in (0, -1, 1.5, True, None):
        with pytest.raises(ValueError):
            urls.page_size(bad)
    z, x, y = F.lit(16), F.lit(3), F.lit(5)
    r = spark.range(1).select(urls.wmts("https://w.example", "top", "default", "G", z, x, y).alias("w"), urls.building_tile(["h/"], F.lit(0), F.lit(17), x, y, "t").alias("none"), urls.latest_release(F.lit("<Prefix>tiles/2026-06-17.0/</Prefix><Prefix>tiles/2026-07-22.0/</Prefix>")).alias("l"), urls.latest_release(F.lit("")).alias("no"), urls.wfs("https://w.example?", "lay", z, x, y, True).alias("f"), urls.release_archive("https://b.example/", F.lit("<Prefix>tiles/1/</Prefix>")).alias("a")).first()
    assert r["w"] == "https://w.example/tile/1.0.0/top/default/G/16/5/3.png" and r["none"] is None and r["l"] == "2026-07-22.0" and r["no"] is None
    assert "typeNames=lay" in r["f"] and r["f"].endswith("urn:ogc:def:crs:EPSG:4326") and r["a"] == "https://b.example/tiles/1/buildings.pmtiles"
    with pytest.raises(ValueError):
        urls.model_tile("h", "t", z, x, y, " ")


def service(folder, url, n, size, last_status=None):
    index = {}
    for start in range(0, n + 1, size):
        got = [{"type": "Feature", "id": i} for i in range(start, min(n, start + size))]
        if start == n and not got and last_status:
            index[urls.with_page(url, size, start)] = {"status": last_status}
        else:
            name = f"{abs(hash(url))}_{start}.json"
            (folder / name).write_text(json.dumps({"features": got}))
            index[urls.with_page(url, size, start)] = {"status": 200, "file": name}
    return index


def test_paged_feature_service(spark, tmp_path):
    a, b = "https://w.example/ows?l=a", "https://w.example/ows?l=b"
    (tmp_path / "index.json").write_text(json.dumps(service(tmp_path, a, 5, 2) | service(tmp_path, b, 4, 2, 400)))
    spark.dataSource.register(wfs.FeatureService)
    ask = [["t1", a], ["t2", b], ["t2 again", b], ["t3", "https://w.example/ows?l=none"]]
    got = spark.read.format("feature_service").option("requests", json.dumps(ask)).option("pagesize", "2").option("folder", str(tmp_path)).option("retries", "1").load().collect()
    assert sorted((r["tile"], json.loads(r["feature"])["id"]) for r in got if r["feature"]) == [("t1", i) for i in range(5)] + [("t2", i) for i in range(4)]
    assert [(r["tile"], r["error"]) for r in got if r["error"]] == [("t3", "HTTP 404")]


def test_page_chains_end():
    calls = []

    def fetch(url):
        calls.append(url)
        return (200, '{"features": [1, 2]}') if len(calls) == 1 else (416, "")

    assert [p[2] for p in wfs.pages("https://w.example/x", 2, fetch)] == [[1, 2], []] and len(calls) == 2
    assert list(wfs.pages("https://w.example/x", None, lambda u: (500, ""), retries=2))[0][3] == "HTTP 500"
    assert list(wfs.pages("https://w.example/x", None, lambda u: (200, "{")))[0][3].startswith("unreadable")


def test_files_go_out_and_come_in(spark, tmp_path):
    f = spark.createDataFrame([('a"1', '{"h": 3}', "Point", "[1, 2]"), (None, None, "Point", None)], "id string, properties string, geometry_type string, coordinates string")
    sinks.write_geojson(f, str(tmp_path), "out")
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out.json")).collect()]
    assert sorted(x["id"] or "" for x in lines) == ["", 'a"1'] and {"type": "Point", "coordinates": [1, 2]} in [x["geometry"] for x in lines]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.json").write_text(json.dumps({"crs": None, "features": [{"id": 5, "properties": {"a": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    r = files.geojson(spark, str(tmp_path / "in")).collect()
    assert len(r) == 1 and (r[0]["id"], r[0]["geometry_type"], r[0]["feature_no"]) == ("5", "Point", 0)
    (tmp_path / "p.csv").write_text('Latitude,Longitude,Short Description,Long Description\n1.5,2.5,"a, b","line\none ""q"""\n')
    p = files.csv_points(spark, str(tmp_path / "p.csv")).first()
    assert tuple(p) == (2.5, 1.5, "a, b", 'line\none "q"')
    sinks.write_csv(spark.createDataFrame([('x,"y"', 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["a"] == 'x,"y"'
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "14_3_5.glb").write_bytes(b"glTF")
    m = files.model_tiles(spark, str(tmp_path / "m")).first()
    assert (m["z"], m["x"], m["y"], bytes(m["content"])) == (14, 3, 5, b"glTF")


def test_tiles_are_saved_with_bounded_tries(spark, tmp_path):
    t = spark.createDataFrame([(3, 1, 2, "ok"), (3, 1, 3, "never")], "z int, x long, y long, url string")
    fetch = lambda u: (200, b"img") if u == "ok" else (503, b"")
    got = {r["y"]: (r["saved"], r["attempts"]) for r in sinks.save_tiles(t, str(tmp_path / "tiles"), fetch, tries=3, wait=0).collect()}
    assert got == {2: (True, 1), 3: (False, 3)} and (tmp_path / "tiles" / "3_2_1.png").read_bytes() == b"img"
