"""Deeply nested records as related flat tables, linked by interval labels.

Every body is walked depth first; each node gets its pre-order and post-order number. Node rows of each type carry
only their own labels and their place among their siblings. A child belongs to the parent of a type whose interval
contains its own (parent.pre < child.pre and child.post < parent.post); no keys are handed down during the walk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Node types, by number in the arrays below.
KINDS = ("collection", "feature", "ring", "source", "name", "address", "unit")
COLLECTION, FEATURE, RING, SOURCE, NAME, ADDRESS, UNIT = range(7)
#: Nesting of coordinates above one path.
DEPTH = {"Point": 0, "LineString": 0, "MultiPoint": 1, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 2}


def content(v: object) -> object:
    """v, or what it holds where it is JSON given as text."""
    for _ in range(3):
        if not isinstance(v, str) or v.lstrip()[:1] not in ("{", "[", '"'):
            return v
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return None
    return v


def entries(v: object) -> list:
    """The entries of what should be an array: a single object is an array of one; else nothing."""
    v = content(v)
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def find_collection(v: object) -> dict | None:
    """The object that holds features, itself or the first one inside an envelope (breadth first)."""
    level = [content(v)]
    for _ in range(8):
        below = []
        for x in level:
            if isinstance(x, dict):
                if "features" in x:
                    return x
                below += [content(y) for y in x.values()]
        level = below
    return None


class _Walk:
    """Labels of one or more bodies; clock runs on from body to body, so that their intervals are disjoint."""

    def __init__(self) -> None:
        self.pre, self.post = 0, 0
        self.rows: list[list] = []  # kind, pre, post, part_no, item_no, body, payload

    def enter(self, kind: int, part: int, item: int, body: int, payload: str | None) -> list:
        row = [kind, self.pre, 0, part, item, body, payload]
        self.pre += 1
        self.rows.append(row)
        return row

    def leave(self, row: list) -> None:
        row[2] = self.post
        self.post += 1

    def leaf(self, *x) -> None:
        self.leave(self.enter(*x))


def _paths(geometry: object) -> Iterator[tuple[int, int, object]]:
    """(part_no, item_no, coordinates) of each path of a geometry."""
    part, todo = 0, [geometry]
    while todo:
        g = content(todo.pop())
        if not isinstance(g, dict):
            continue
        kind = g.get("type")
        if kind == "GeometryCollection":
            todo += reversed(entries(g.get("geometries")))
            continue
        c = content(g.get("coordinates"))
        deep = DEPTH.get(kind) if isinstance(kind, str) else None
        if deep is None:
            continue
        if not isinstance(c, list) or not c:
            part += not kind.startswith("Multi")
            continue
        if kind.startswith("Multi"):
            for k, x in enumerate(c):
                if isinstance(x, list) and x:
                    for i, y in enumerate(x) if deep == 2 else ((0, x),):
                        if isinstance(y, list) and y:
                            yield part + k, i, y
            part += len(c)
        else:
            for i, y in enumerate(c) if deep else ((0, c),):
                if isinstance(y, list) and y:
                    yield part, i, y
            part += 1


def walk_body(w: _Walk, body: object, no: int, payload: bool) -> bool:
    """Adds a body's nodes to w; False if it holds no collection of features."""
    try:
        top = find_collection(json.loads(body) if isinstance(body, str) else None)
    except (ValueError, RecursionError):
        return False
    if top is None:
        return False
    text = (lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))) if payload else lambda x: None
    root = w.enter(COLLECTION, 0, 0, no, None)
    for k, f in enumerate(entries(top.get("features"))):
        f = content(f)
        if not isinstance(f, dict):
            continue  # a null entry counts, but is no feature
        p = content(f.get("properties"))
        p = p if isinstance(p, dict) else {}
        node = w.enter(FEATURE, 0, k, no, text({"id": f.get("id"), "properties": p}))
        for part, item, c in _paths(f.get("geometry")):
            w.leaf(RING, part, item, no, text(c))
        names = content(p.get("names"))
        for kind, v in ((SOURCE, p.get("sources")), (NAME, names.get("common") if isinstance(names, dict) else None)):
            for i, x in enumerate(entries(v)):
                if x is not None:
                    w.leaf(kind, 0, i, no, text(x))
        for i, x in enumerate(entries(p.get("addresses"))):
            if x is None:
                continue
            x = content(x)
            a = w.enter(ADDRESS, 0, i, no, text(x))
            for j, u in enumerate(entries(x.get("units") if isinstance(x, dict) else None)):
                if u is not None:
                    w.leaf(UNIT, 0, j, no, text(u))
            w.leave(a)
        w.leave(node)
    w.leave(root)
    return True


def containing(pre: np.ndarray, post: np.ndarray, of_pre: np.ndarray, of_post: np.ndarray) -> np.ndarray:
    """For each interval the index of the interval of another, non-overlapping set that contains it, or -1."""
    at = np.searchsorted(of_pre, pre) - 1
    ok = at >= 0
    ok[ok] &= post[ok] < of_post[at[ok]]
    return np.where(ok, at, -1)


SCHEMA = "page_id bigint, kind string, pre bigint, post bigint, feature_no int, feature_pre bigint, parent_pre bigint, part_no int, item_no int, payload string"


def node_table(pages: DataFrame, page_id: str = "page_id", body: str = "body", payload: bool = True) -> DataFrame:
    """One row for each node of the collections in pages' bodies, of every kind in KINDS.

    pre and post are the node's labels within its page; feature_no, feature_pre and parent_pre (of a unit its
    address, of any other child its feature) come from interval containment. part_no and item_no are places, from 0.
    Null, empty, cut-off or otherwise invalid bodies, null features and null or empty arrays give no rows; a null
    entry keeps its place. Repeated pages give their rows again, under their own id. A body is read whole, however
    long, by one task. Other columns of pages are not read, so their names cannot clash.
    """
    narrow = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(body).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for lo in range(0, len(ids), 64):
                w, first = _Walk(), {}
                for no in range(lo, min(lo + 64, len(ids))):
                    first[no] = (w.pre, w.post)
                    walk_body(w, bodies[no].as_py(), no, payload)
                if w.rows:
                    yield _linked(w.rows, ids, first)

    def _linked(rows: list[list], ids: np.ndarray, first: dict) -> pa.RecordBatch:
        kind, pre, post, part, item, no = (np.array([r[i] for r in rows]) for i in range(6))
        f, a = kind == FEATURE, kind == ADDRESS
        in_f, in_a = containing(pre, post, pre[f], post[f]), containing(pre, post, pre[a], post[a])
        own = np.where(f, np.cumsum(f) - 1, in_f)
        has = own >= 0
        fno, fpre = (np.append(x[f], -1)[own] for x in (item, pre))
        unit = kind == UNIT
        part = np.where(unit, np.append(item[a], -1)[in_a], part)
        base_pre, base_post = (np.array([first[n][i] for n in no]) for i in range(2))
        parent = np.where(unit, np.append(pre[a], -1)[in_a], np.where(f, base_pre, fpre))
        mask = lambda x, bad, t: pa.array(x, t, mask=bad)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[no], pa.int64()), pa.array(np.array(KINDS, dtype=object)[kind], pa.string()), pa.array(pre - base_pre, pa.int64()), pa.array(post - base_post, pa.int64()),
                mask(fno, ~has, pa.int32()), mask(fpre - base_pre, ~has, pa.int64()), mask(parent - base_pre, kind == COLLECTION, pa.int64()), pa.array(part, pa.int32()), pa.array(item, pa.int32()), pa.array([r[6] for r in rows], pa.string()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    return narrow.mapInArrow(run, SCHEMA)


def children(nodes: DataFrame) -> DataFrame:
    """Rows below features: page, feature, kind of child and its two numbers."""
    return nodes.filter(~F.col("kind").isin("collection", "feature")).select("page_id", "feature_no", F.col("kind").alias("child"), "part_no", "item_no")


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """features, paths and one table of items per kind, each with the labels that link it to its parent."""
    label = ["page_id", "feature_no", "pre", "post", "parent_pre"]
    out = {
        "features": nodes.filter("kind = 'feature'").select(*label, F.get_json_object("payload", "$.id").alias("id"), F.get_json_object("payload", "$.properties").alias("properties")),
        "paths": nodes.filter("kind = 'ring'").select(*label, "part_no", "item_no", F.from_json("payload", "array<array<double>>").alias("positions"), F.from_json("payload", "array<double>").alias("position")),
    }
    for k in ("source", "name", "address", "unit"):
        out[f"{k}s" if k != "address" else "addresses"] = nodes.filter(F.col("kind") == k).select(*label, "part_no", "item_no", "payload")
    return out


def link_by_interval(child: DataFrame, parent: DataFrame) -> DataFrame:
    """child with parent_label: pre of the innermost parent whose interval contains it, in SQL, one pass a page.

    Intervals of one type nest or are disjoint; for disjoint parents the containing one is the last that began
    before the child, so that no pairs are formed.
    """
    both = child.select("page_id", "pre", "post", F.lit(False).alias("is_parent")).unionByName(parent.select("page_id", "pre", "post", F.lit(True).alias("is_parent")))
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    got = F.last(F.when(F.col("is_parent"), F.struct("pre", "post")), ignorenulls=True).over(w)
    return both.withColumn("p", got).filter(~F.col("is_parent")).select("page_id", "pre", "post", F.when(F.col("post") < F.col("p.post"), F.col("p.pre")).alias("parent_label"))
