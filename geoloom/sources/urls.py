"""Request addresses of tile and feature services, as column expressions. Hosts and tokens are parameters."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.operators.grid import tile_box

#: Deepest zoom of building tiles; features in a page where the service pages.
BUILDING_ZOOM, PAGE_SIZE = 16, 3000


def mirror(hosts: list[str], index: Column) -> Column:
    """Round robin over mirrors, by the request's number."""
    return F.get(F.array(*map(F.lit, hosts)), F.pmod(index, F.lit(len(hosts))).cast("int"))


def slippy(host: Column, z: Column, x: Column, y: Column, ending: str) -> Column:
    return F.concat(host, z.cast("string"), F.lit("/"), x.cast("string"), F.lit("/"), y.cast("string"), F.lit(ending))


def building_tile(hosts: list[str], index: Column, z: Column, x: Column, y: Column, token: str) -> Column:
    """NULL beyond the zoom that building tiles exist for."""
    return F.when(z <= BUILDING_ZOOM, slippy(mirror(hosts, index), z, x, y, f".json?token={token}"))


def satellite(host: str, map_type: str, z: Column, x: Column, y: Column, sku: Column, token: str, boosted: bool = False) -> Column:
    query = F.concat(F.lit("?sku="), F.url_encode(sku), F.lit("&access_token="), F.url_encode(F.lit(token)))
    return F.concat(slippy(F.lit(f"{host}{map_type}/"), z, x, y, ("@2x" if boosted else "") + ".jpg90"), query)


def elevation(host: str, map_type: str, z: Column, x: Column, y: Column, sku: Column, token: str, boosted: bool = False) -> Column:
    """Elevation tiles end at zoom 15, at 14 in double resolution; beyond there is no address (null)."""
    return F.concat(slippy(F.lit(f"{host}{map_type}/"), F.when(z <= (14 if boosted else 15), z), x, y, ("@2x" if boosted else "") + ".pngraw"), F.lit("?sku="), sku, F.lit(f"&access_token={token}"))


def wmts(base: str, layer: str, style: str, matrix_set: str, z: Column, x: Column, y: Column, ending: str = ".png", cache: str | None = None) -> Column:
    """Row before column; cache names a folder of tiles saved before, as z_y_x."""
    if cache is not None:
        return F.concat(F.lit(f"{cache.rstrip('/')}/map_cache/"), z.cast("string"), F.lit("_"), y.cast("string"), F.lit("_"), x.cast("string"), F.lit(ending))
    return slippy(F.lit(f"{base}/tile/1.0.0/{layer}/{style}/{matrix_set}/"), z, y, x, ending)


def page_size(n: object = PAGE_SIZE) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("the page size must be a positive integer")
    return n


def wfs(url: str, layer: str, z: Column, x: Column, y: Column, paging: bool = False) -> Column:
    """GetFeature within a tile's box (latitude first), in one go or, where paging, as version 2.0.0."""
    b = tile_box(x, y, z)
    version, name, output = ("&version=2.0.0", "&typeNames=", "&outputFormat=GEOJSON") if paging else ("", "&typeName=", "&outputFormat=application%2Fjson")
    box = F.concat_ws(",", *(b[c].cast("string") for c in ("min_lat", "min_lon", "max_lat", "max_lon")), F.lit("urn:ogc:def:crs:EPSG:4326"))
    return F.concat(F.lit(f"{url}service=WFS{version}&request=GetFeature{name}{layer}{output}&bbox="), box)


def with_page(url: str, count: int, start: int) -> str:
    """url with count and startIndex set or replaced; a relative one just gets them at its end."""
    s = urlsplit(url)
    if not s.scheme or not s.netloc:
        joint = "" if url.endswith(("?", "&")) else "&" if "?" in url else "?"
        return f"{url}{joint}count={count}&startIndex={start}"
    want = {"count": str(count), "startIndex": str(start)}
    query, seen = [], set()
    for k, v in parse_qsl(s.query, keep_blank_values=True):
        if k in want:
            if k in seen:
                continue
            v = want[k]
            seen.add(k)
        query.append((k, v))
    query += [(k, v) for k, v in want.items() if k not in seen]
    return urlunsplit((s.scheme, s.netloc, s.path or "/", urlencode(query), s.fragment))


def next_page(returned: Column, size: Column, start: Column, status: Column) -> Column:
    """startIndex of the page to ask for next; NULL where the chain ends: a short page, or 400/416 after the first."""
    return F.when((status == 200) & (returned >= size), start + returned)


def clean_end(status: Column, start: Column) -> Column:
    return status.isin(400, 416) & (start > 0)


def newest_release(listing: str) -> str:
    """latest_release of one listing held as text; an empty one is an error, as nothing could be read."""
    names = re.findall(r"<Prefix>[^<]*?([^<>/]+)/</Prefix>", listing)
    if not names:
        raise ValueError("the listing names no release")
    return max(names)


def latest_release(listing: Column) -> Column:
    """The last, by name, of the releases in a bucket listing; NULL if there is none."""
    return F.array_max(F.regexp_extract_all(listing, F.lit(r"<Prefix>tiles/([^<]+)/</Prefix>"), F.lit(1)))


def release_archive(base: str, listing: Column) -> Column:
    r = latest_release(listing)
    return F.concat(F.lit(base.rstrip("/") + "/tiles/"), r, F.lit("/buildings.pmtiles"))


def model_tile(host: str, tileset: str, z: Column, x: Column, y: Column, token: str) -> Column:
    if not token.strip():
        raise ValueError("model tiles need an access token")
    return F.concat(slippy(F.lit(f"{host}{tileset}/"), z, x, y, ".glb?access_token="), F.url_encode(F.lit(token)))
