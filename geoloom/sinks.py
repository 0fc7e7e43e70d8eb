"""Where results go: feature collections, tile files and tables of properties."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_geojson(features: DataFrame, path: str, name: str) -> None:
    """One feature a line under path/name.json (a folder of parts, so that no file has to hold all).

    features has id, properties, geometry_type and coordinates, the last two texts of JSON.
    """
    q = lambda c: F.to_json(F.array(F.col(c)))
    line = F.concat(F.lit('{"type":"Feature","id":'), F.when(F.col("id").isNull(), "null").otherwise(F.expr("substring(to_json(array(id)), 2, length(to_json(array(id))) - 2)")), F.lit(',"properties":'), F.coalesce("properties", F.lit("{}")), F.lit(',"geometry":{"type":"'), F.col("geometry_type"), F.lit('","coordinates":'), F.coalesce("coordinates", F.lit("null")), F.lit("}}"))
    features.select(line.alias("value")).write.mode("overwrite").text(os.path.join(path, f"{name}.json"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def save_tiles(tiles: DataFrame, folder: str, fetch: Callable[[str], tuple[int, bytes]], ending: str = ".png", tries: int = 10, wait: float = 1.0) -> DataFrame:
    """z, x, y, saved, attempts: each tile's image (column url) written as z_y_x, tried a bounded number of times.

    folder is an address that all executors reach (a path they share, hdfs://, s3:// and the like, as Arrow knows
    them). A file is written under a passing name and then moved, so a task that runs twice leaves no half of it.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                status, k = 0, 0
                while status != 200 and k < tries:
                    k += 1
                    try:
                        status, body = fetch(r.url)
                    except OSError:
                        status = 0
                    if status != 200 and k < tries:
                        time.sleep(wait)
                if status == 200:
                    name = f"{root}/{r.z}_{r.y}_{r.x}{ending}"
                    passing = f"{name}.{uuid.uuid4().hex}"
                    with files.open_output_stream(passing) as f:
                        f.write(body)
                    files.move(passing, name)
                out.append((r.z, r.x, r.y, status == 200, k))
            yield pd.DataFrame(out, columns=["z", "x", "y", "saved", "attempts"])

    return tiles.select("z", "x", "y", "url").mapInPandas(run, "z int, x bigint, y bigint, saved boolean, attempts int")
