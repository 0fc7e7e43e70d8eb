"""Feature services as a data source: one partition a tile, its chain of pages read within.

The fetch function is a parameter (url -> status, body), so that the reader works on saved responses as on a service.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.sources.urls import page_size, with_page

Fetch = Callable[[str], tuple[int, str]]
SCHEMA = "tile string, url string, feature_no int, status int, feature string, error string"


def http(url: str) -> tuple[int, str]:
    """Status and body; status 0 and the reason where there was no answer (refused, timed out, no such host)."""
    from http.client import HTTPException
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, ""
    except (OSError, HTTPException, ValueError) as e:
        return 0, str(e)


def folder_fetch(folder: str) -> Fetch:
    """Answers from a folder with index.json: {url: {"status": 200, "file": "name"}}; unknown addresses are 404.

    Without an index.json the folder is one saved body (response.json), which answers every address.
    """

    def fetch(url: str) -> tuple[int, str]:
        if not os.path.exists(f"{folder}/index.json"):
            with open(f"{folder}/response.json", encoding="utf-8") as f:
                return 200, f.read()
        with open(f"{folder}/index.json", encoding="utf-8") as f:
            hit = json.load(f).get(url)
        if hit is None:
            return 404, ""
        if "file" not in hit:
            return hit["status"], ""
        with open(f"{folder}/{hit['file']}", encoding="utf-8") as f:
            return hit["status"], f.read()

    return fetch


def pages(url: str, size: int | None, fetch: Fetch, retries: int = 3, wait: float = 0.0) -> Iterator[tuple[str, int, list, str | None]]:
    """(address, status, features, error) of each page; size None asks once.

    A short page ends the chain, as does 400 or 416 after the first page; asked once, 204 and 404 are no features.
    Other failures, no answer among them, are tried again a bounded number of times and then reported.
    """
    empty = (204, 404) if size is None else ()
    start = 0
    while True:
        at = url if size is None else with_page(url, size, start)
        for k in range(retries + 1):
            status, body = fetch(at)
            if status == 200 or status in empty or (size is not None and start > 0 and status in (400, 416)):
                break
            if k < retries:
                time.sleep(wait)
        if status in empty:
            yield at, status, [], None
            return
        if status != 200:
            ended = size is not None and start > 0 and status in (400, 416)
            yield at, status, [], None if ended else f"HTTP {status}" if status else f"no answer: {body}"
            return
        try:
            got = json.loads(body).get("features") or []
        except (ValueError, AttributeError) as e:
            yield at, status, [], f"unreadable: {e}"
            return
        yield at, status, got, None
        if size is None or len(got) < size:
            return
        start += len(got)


class TilePartition(InputPartition):
    def __init__(self, tile: str, url: str) -> None:
        self.tile, self.url = tile, url


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.requests = json.loads(options["requests"])  # [[tile, url], ...]
        self.size = page_size(int(options["pagesize"])) if options.get("pagesize") else None
        self.folder = options.get("folder")
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        # The same address is asked for once, whoever wants it.
        return [TilePartition(t, u) for u, t in {u: t for t, u in reversed(self.requests)}.items()] or [TilePartition("", "")]

    def read(self, partition: TilePartition) -> Iterator[tuple]:
        if not partition.url:
            return
        fetch = folder_fetch(self.folder) if self.folder else http
        for url, status, got, error in pages(partition.url, self.size, fetch, self.retries):
            if error:
                yield partition.tile, url, None, status, None, error
            for i, f in enumerate(got):
                yield partition.tile, url, i, status, json.dumps(f), None


class FeatureService(DataSource):
    """spark.read.format("feature_service").option("requests", json).option("pagesize", n).load()"""

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options)


def fetch_features(requests: DataFrame, fetch: Fetch = http, size: int | None = None, retries: int = 3) -> DataFrame:
    """SCHEMA of the features behind requests (tile, url), a table of any length; each address is asked for once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for tile, url in zip(b["tile"], b["url"], strict=True):
                for _, status, got, error in pages(url, size, fetch, retries):
                    rows = [(tile, url, i, status, json.dumps(f), None) for i, f in enumerate(got)]
                    yield pd.DataFrame(rows + ([(tile, url, None, status, None, error)] if error else []), columns=columns, dtype=object)

    once = requests.filter("url IS NOT NULL").groupBy("url").agg(F.min(F.col("tile").cast("string")).alias("tile"))
    return once.select("tile", "url").mapInPandas(run, SCHEMA)


def complete(features: DataFrame) -> DataFrame:
    """Features of tiles whose whole chain of pages was read: only these can be merged."""
    return features.join(features.filter("error IS NOT NULL").select("url").distinct(), "url", "left_anti")
