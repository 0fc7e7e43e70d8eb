"""Texts packed into containers of fixed capacity with little room left.

Items are cut only if they alone exceed the capacity. Within randomised groups of documents of about equal number
(and never across values of the field that keeps containers apart), items go first-fit in decreasing order of size;
the first container with room is found by descending a tournament tree over the containers' remaining capacities.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.encoding import token_counts
from geoloom.session import cut

#: Documents in a group, on average: enough for small leftovers, few enough for one task.
GROUP = 20_000


class Tournament:
    """Remaining capacities of containers; each inner node holds the larger of its two below."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.base = 1 << max(0, (leaves - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Number of the first container with room for size, which it takes."""
        room, at = self.room, 1
        while at < self.base:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.base
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; sizes must be at most capacity, and largest first."""
    tree = Tournament(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


def pack(docs: DataFrame, specs: DataFrame, id_column: str = "doc_id", text: str = "text", file: str | None = None, group: int = GROUP) -> DataFrame:
    """spec_id, container, doc_id, piece and size: each document's pieces (numbered from 0) and where they lie.

    A text longer than the capacity is cut into full pieces and a rest; any other is one piece. A null or empty text
    is one piece of size 0. specs has spec_id, capacity_tokens and per_field, the column within whose values (null
    being one) containers are kept apart; a field that docs lacks is refused. Containers are numbered within spec,
    value and group; their names say which. Groups are drawn by a hash of the document's id, so a value or source that
    holds a third of all documents is many groups. Ties in size go by id and piece; repeated ids are packed each.
    A spec with no capacity gives an error. An empty table gives no rows.
    """
    wanted = [r for r in specs.select("spec_id", "capacity_tokens", "per_field").distinct().collect()]
    fields = sorted({r["per_field"] for r in wanted if r["per_field"]})
    if lacking := [f for f in fields if f not in docs.columns]:
        raise ValueError(f"documents have no column {lacking}")
    if any(not r["capacity_tokens"] or r["capacity_tokens"] < 1 for r in wanted):
        raise ValueError("a capacity must be at least 1")
    names = {f: f"__v{i}" for i, f in enumerate(fields)}
    narrow = docs.select(F.col(id_column).alias("doc_id"), *(F.col(f).cast("string").alias(v) for f, v in names.items()), F.col(text).alias("__text"))
    sized = cut(token_counts(narrow, "doc_id", "__text", tuple(names.values()), file))
    total = sized.count()
    parts = []
    # One pass a spec (a handful); the sizes were counted once.
    for r in wanted:
        cap = int(r["capacity_tokens"])
        if r["per_field"]:
            own = sized.select("doc_id", "size", F.col(names[r["per_field"]]).alias("value"))
            counts = own.groupBy("value").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(group))).cast("int").alias("groups"))
            own = own.join(counts.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).drop("v")
        else:
            own = sized.select("doc_id", "size", F.lit(None).cast("string").alias("value"), F.lit(max(1, -(-total // group))).alias("groups"))
        own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(r["spec_id"])), F.col("groups")).cast("int"))
        last = F.greatest(F.lit(0), F.ceil(F.col("size") / F.lit(cap)).cast("int") - 1)
        pieces = own.select("doc_id", "value", "part", "size", F.posexplode(F.sequence(F.lit(0), last)).alias("piece", "_"))
        parts.append(pieces.select(F.lit(r["spec_id"]).cast("int").alias("spec_id"), F.lit(cap).alias("capacity"), "value", "part", "doc_id", "piece", F.least(F.lit(cap), F.col("size") - F.col("piece") * F.lit(cap)).cast("int").alias("size")))
    if not parts:
        return sized.select(F.lit(None).cast("int").alias("spec_id"), F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), "size").limit(0)
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(f["size"].tolist(), int(f["capacity"].iloc[0]))
        spec, value, part = (f[c].iloc[0] for c in ("spec_id", "value", "part"))
        name = f"{spec}/{'~' if value is None or value != value else '=' + value}/{part}/"
        return pd.DataFrame({"spec_id": f["spec_id"], "container": [f"{name}{b}" for b in bins], "doc_id": f["doc_id"], "piece": f["piece"], "size": f["size"]})

    kind = sized.schema["doc_id"].dataType.simpleString()
    return items.groupBy("spec_id", "value", "part").applyInPandas(fill, f"spec_id int, container string, doc_id {kind}, piece int, size int")
