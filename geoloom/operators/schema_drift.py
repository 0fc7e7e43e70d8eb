"""Schemas that drift between files: every change found, every file read into one stable set of columns.

Each file's fields form a tree of names and JSON types. Consecutive files of a feed are compared by a tree edit
distance over unordered trees: at each level children are matched at the least cost, where a rename costs as much as
the values of the same records disagree, and a deletion or insertion costs the size of its subtree. The minimum-cost
script of add, delete, rename, move and retype steps is compiled into a projection of each file's paths: renames and
moves say which column a path belongs to, retypes which columns' values are taken out of their dress.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut, scratch, stored

#: A new key may take over a gone one only if at least this share of the records that have both agree, and if keys that
#: have nothing to do with each other, of values as frequent, agree as often less than once in so many cases.
AGREE, CHANCE = 0.7, 100.0
ID_KEYS = ("OBJECTID", "id")
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,9})?")

EX_SCHEMA = "feed_id int, file_id int, exported_at timestamp, rec string, path string, jtype string, vhash bigint"


def json_type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


#: What a number can begin with.
NUMERIC = frozenset("0123456789+-.")


def plain(v: object) -> str | None:
    """The value without its dress: 4, 4.0, "4", ["4"] and {"value": 4} are one value."""
    while isinstance(v, (list, dict)) and len(v) == 1:
        v = v[0] if isinstance(v, list) else next(iter(v.values()))
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, dict)):
        return json.dumps(v, sort_keys=True)
    s = str(v).strip()
    if s[:1] not in NUMERIC:
        return s
    try:
        x = float(s)
    except (ValueError, OverflowError):
        return s
    return f"{x:.12g}" if x == x and abs(x) != float("inf") else s


@lru_cache(maxsize=1 << 16)
def text_hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def value_hash(v: object) -> int | None:
    s = plain(v)
    return None if s is None else text_hash(s)


def _fields(prefix: str, v: object, out: list) -> None:
    for k, x in v.items():
        path = f"{prefix}{k}" if not prefix else f"{prefix}\x1f{k}"
        out.append((path, json_type(x), value_hash(x)))
        if isinstance(x, dict):
            _fields(path, x, out)


def explode_fields(rows: DataFrame, properties: str = "properties") -> DataFrame:
    """One row for each key (nested ones by path) of each row's JSON object; null or invalid objects give none."""
    narrow = rows.select(F.col("feed_id").cast("int"), F.col("file_id").cast("int"), F.col("exported_at").cast("timestamp"), F.col(properties).cast("string").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, recs, got = [], [], []
            for i, text in enumerate(b.column(3)):
                try:
                    v = json.loads(text.as_py() or "null")
                except (ValueError, RecursionError):
                    continue
                if not isinstance(v, dict):
                    continue
                n = len(got)
                _fields("", v, got)
                rec = next((f"{k}={plain(v[k])}" for k in ID_KEYS if v.get(k) is not None), None)
                at += [i] * (len(got) - n)
                recs += [rec] * (len(got) - n)
            if got:
                head = b.select([0, 1, 2]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(recs, pa.string()), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=[x.split()[0] for x in EX_SCHEMA.split(", ")])

    return narrow.mapInArrow(run, EX_SCHEMA)


def parsed(rows: DataFrame) -> DataFrame:
    """explode_fields, done once and kept in the shared folder, as it is read several times."""
    return stored(explode_fields(rows), f"{scratch(rows.sparkSession, 'fields')}/rows")


def file_schemas(ex: DataFrame, all_types: bool = False) -> DataFrame:
    """feed_id, file_id, exported_at, fields: each file's paths with the type of most of their non-null values.

    all_types: with the types of all their values, too.
    """
    per_type = ex.groupBy("feed_id", "file_id", "path", "jtype").agg(F.count("*").alias("n"), F.min("exported_at").alias("at"))
    # Most first; a tie goes to the type that comes first by name.
    best = F.min(F.when(F.col("jtype").isNotNull(), F.struct((-F.col("n")).alias("n"), "jtype"))).alias("best")
    per_path = per_type.groupBy("feed_id", "file_id", "path").agg(best, F.min("at").alias("at"), *([F.collect_set("jtype").alias("types")] if all_types else []))
    return per_path.groupBy("feed_id", "file_id").agg(F.min("at").alias("exported_at"), F.collect_list(F.struct("path", F.col("best.jtype").alias("jtype"), *(["types"] if all_types else []))).alias("fields"))


def file_pairs(schemas: DataFrame) -> DataFrame:
    """Each file with the file of the same feed exported just before; a file without a time comes last."""
    w = Window.partitionBy("feed_id").orderBy(F.col("exported_at").asc_nulls_last(), "file_id")
    return schemas.withColumn("seq", F.row_number().over(w)).withColumn("prev", F.lag(F.struct("file_id", "fields")).over(w)).select("feed_id", "file_id", "seq", "exported_at", "fields", F.col("prev.file_id").alias("prev_id"), F.col("prev.fields").alias("prev_fields"))


def rename_evidence(ex: DataFrame, pairs: DataFrame) -> DataFrame:
    """For gone and new keys of each pair of files: records that have both, and those whose values agree."""
    names = lambda c: F.transform(c, lambda x: x["path"])
    diff = pairs.filter("prev_id IS NOT NULL").select("feed_id", "file_id", "prev_id", F.array_except(names(F.col("prev_fields")), names(F.col("fields"))).alias("gone"), F.array_except(names(F.col("fields")), names(F.col("prev_fields"))).alias("came")).filter("size(gone) > 0 AND size(came) > 0")
    side = lambda of, keys, new: diff.select("feed_id", F.col(of).alias("of"), F.col("file_id").alias("pair"), F.explode(keys).alias("path"), F.lit(new).alias("new"))
    wanted = side("prev_id", "gone", False).unionByName(side("file_id", "came", True))
    have = ex.filter("rec IS NOT NULL AND vhash IS NOT NULL").select("feed_id", F.col("file_id").alias("of"), "rec", "path", "vhash")
    # A record repeated in a file counts once, so no group of repeats meets another; what a record lost and gained are
    # a few keys.
    once = cut(have.join(wanted, ["feed_id", "of", "path"]).groupBy("feed_id", "pair", "rec", "path", "new").agg(F.max("vhash").alias("v")))
    keys = lambda new: F.collect_list(F.when(F.col("new") == F.lit(new), F.struct("path", "v")))
    both = once.groupBy("feed_id", "pair", "rec").agg(keys(False).alias("o"), keys(True).alias("n")).filter("size(o) > 0 AND size(n) > 0")
    both = both.select("feed_id", F.col("pair").alias("file_id"), F.explode("o").alias("o"), "n").select("feed_id", "file_id", "o", F.explode("n").alias("n"))
    met = both.groupBy("feed_id", "file_id", F.col("o.path").alias("old"), F.col("n.path").alias("new")).agg(F.count("*").alias("both"), F.sum((F.col("o.v") == F.col("n.v")).cast("long")).alias("same"))
    # How often values as frequent as these agree by chance.
    often = once.groupBy("feed_id", F.col("pair").alias("file_id"), "path", "new", "v").agg(F.count("*").alias("n"))
    key = lambda new, name: often.filter(F.col("new") == F.lit(new)).select("feed_id", "file_id", "v", F.col("path").alias(name), F.col("n").alias(f"n_{name}"))
    meets = key(False, "old").join(key(True, "new"), ["feed_id", "file_id", "v"]).groupBy("feed_id", "file_id", "old", "new").agg(F.sum(F.col("n_old").cast("double") * F.col("n_new")).alias("meets"))
    total = lambda new, name: key(new, name).groupBy("feed_id", "file_id", name).agg(F.sum(f"n_{name}").cast("double").alias(f"all_{name}"))
    met = met.join(meets, ["feed_id", "file_id", "old", "new"]).join(total(False, "old"), ["feed_id", "file_id", "old"]).join(total(True, "new"), ["feed_id", "file_id", "new"])
    met = met.withColumn("chance", F.col("meets") / (F.col("all_old") * F.col("all_new")))
    return met.groupBy("feed_id", "file_id").agg(F.collect_list(F.struct("old", "new", "both", "same", "chance")).alias("evidence"))


def agreement(both: int, same: int, chance: float) -> float:
    """Share of the records whose values agree; 0 if chance may as well have made them (Chernoff's bound). Full agreement always counts."""
    share = same / both
    if same == both:
        return 1.0
    if share <= chance:
        return 0.0
    apart = share * math.log(share / chance) + (1 - share) * math.log((1 - share) / (1 - chance))
    return share if both * apart >= math.log(CHANCE) else 0.0


def least_cost(cost: np.ndarray) -> list[int]:
    """Hungarian method: for each row of a cost matrix (rows <= columns) the column assigned to it."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, low[1:])))
            d = low[j1]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if not match[j0]:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def tree(fields: list[tuple[str, str | None]]) -> dict:
    """name -> [type, children] from paths."""
    root: dict = {}
    for path, jtype in sorted(fields):
        level = root
        *above, name = path.split("\x1f")
        for a in above:
            level = level.setdefault(a, [None, {}])[1]
        level.setdefault(name, [None, {}])[0] = jtype
    return root


def weight(node: list) -> int:
    return 1 + sum(weight(c) for c in node[1].values())


def edit_script(old: dict, new: dict, agree: dict[tuple[str, str], float], old_at: str = "", new_at: str = "") -> tuple[float, list[tuple[str, str, str]]]:
    """Cost and steps (change, old path, new path) of the cheapest way from one tree to the other."""
    path = lambda at, k: f"{at}\x1f{k}" if at else k
    cost, steps = 0.0, []
    for k in old.keys() & new.keys():
        a, b = old[k], new[k]
        if a[0] and b[0] and a[0] != b[0]:
            cost += 1
            steps.append(("retyped", path(old_at, k), path(new_at, k)))
        c, s = edit_script(a[1], b[1], agree, path(old_at, k), path(new_at, k))
        cost, steps = cost + c, steps + s
    gone, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    if gone:
        # Columns: the new keys, then for each gone key its own deletion.
        big = 1e6
        c = np.full((len(gone), len(came) + len(gone)), big)
        for i, g in enumerate(gone):
            c[i, len(came) + i] = weight(old[g])
            for j, n in enumerate(came):
                share = agree.get((path(old_at, g), path(new_at, n)), 0.0)
                if share >= AGREE:
                    c[i, j] = (1 - share) - weight(new[n])  # and saves the insertion
        for i, j in enumerate(least_cost(c)):
            g = gone[i]
            if j < len(came):
                n = came[j]
                below, s = edit_script(old[g][1], new[n][1], agree, path(old_at, g), path(new_at, n))
                cost += 1 - agree[path(old_at, g), path(new_at, n)] + below
                steps += [("renamed", path(old_at, g), path(new_at, n)), *s]
                came[j] = None
            else:
                cost += weight(old[g])
                steps.append(("removed", path(old_at, g), ""))
    for n in came:
        if n is not None:
            cost += weight(new[n])
            steps.append(("added", "", path(new_at, n)))
    return cost, steps


def with_moves(steps: list[tuple[str, str, str]], agree: dict[tuple[str, str], float]) -> list[tuple[str, str, str]]:
    """A deletion and an insertion under different parents that hold the same values are one move."""
    gone = [s for s in steps if s[0] == "removed"]
    came = [s for s in steps if s[0] == "added"]
    up = lambda p: p.rpartition("\x1f")[0]
    for share, g, n in sorted(((agree.get((g[1], n[2]), 0.0), g, n) for g in gone for n in came if up(g[1]) != up(n[2])), reverse=True):
        if share >= AGREE and g in steps and n in steps:
            steps.remove(g)
            steps.remove(n)
            steps.append(("moved", g[1], n[2]))
    return steps


def dotted(path: str) -> str:
    return path.replace("\x1f", ".")


CHANGES = "feed_id int, file_id int, seq int, level int, change string, old_field string, new_field string, old_path string, new_path string"


def schema_changes(rows: DataFrame, ex: DataFrame | None = None) -> DataFrame:
    """Every change of each file against the file of its feed exported just before, nested fields by dotted path.

    old_path and new_path are the same with \\x1f between the names, as names may hold dots.

    change is renamed, removed (new_field ''), added (old_field ''), retyped or moved. Rows of a null feed or file
    form a feed or file of their own. A key with only null values has no type and is never retyped. Repeated rows
    count once as evidence. A feed's first file has no changes; an empty table none at all. Other columns are not
    read, so their names cannot clash.
    """
    ex = parsed(rows) if ex is None else ex
    pairs = cut(file_pairs(file_schemas(ex)))  # a row a file, read twice below
    known = pairs.filter("prev_id IS NOT NULL").join(rename_evidence(ex, pairs), ["feed_id", "file_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                agree = {(e["old"], e["new"]): agreement(e["both"], e["same"], e["chance"]) for e in (r.evidence if r.evidence is not None else [])}
                side = lambda fs: tree([(f["path"], f["jtype"]) for f in fs])
                _, steps = edit_script(side(r.prev_fields), side(r.fields), agree)
                out += [(r.feed_id, r.file_id, r.seq, max(o.count("\x1f"), n.count("\x1f")), c, dotted(o), dotted(n), o, n) for c, o, n in with_moves(steps, agree)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])

    return known.select("feed_id", "file_id", "seq", "fields", "prev_fields", "evidence").mapInPandas(run, CHANGES)


def top_level(changes: DataFrame) -> DataFrame:
    """Changes of the keys of the object itself, in the columns of the case table.

    A key that moved under an object is removed here, one that moved out of it is added.
    """
    inside = lambda c: F.instr(c, "\x1f") > 0
    moved = F.col("change") == "moved"
    out, into = moved & ~inside("old_path"), moved & ~inside("new_path")
    return changes.filter((F.col("level") == 0) | out | into).select("file_id", F.when(out, "removed").when(into, "added").otherwise(F.col("change")).alias("change"), F.when(into, "").otherwise(F.col("old_field")).alias("old_field"), F.when(out, "").otherwise(F.col("new_field")).alias("new_field"))


SCALAR = ("number", "string", "boolean")


def assigned(files: list[tuple[object, list[dict], list[tuple[str, str, str]]]]) -> tuple[list[dict[str, str]], dict[str, str]]:
    """For a feed's files in order (number, fields, steps): each one's map from path to stable column; and the type of
    the columns whose values are taken out of their dress.

    A column is called by the first path it had, dotted. Fields below a renamed or moved one go with it.
    """
    now: dict[str, str] = {}
    ever: dict[str, str] = {}
    used: set[str] = set()
    names: list[dict[str, str]] = []
    main: dict[str, str] = {}
    seen: dict[str, set[str]] = {}
    for number, fields, steps in files:
        came_from = {n: o for change, o, n in steps if change in ("renamed", "moved")}
        left = set(came_from.values())
        source: dict[str, str] = {}
        paths = sorted((f["path"] for f in fields), key=lambda p: (p.count("\x1f"), p))
        for p in paths:
            above, _, name = p.rpartition("\x1f")
            source[p] = came_from[p] if p in came_from else f"{source[above]}\x1f{name}" if above else p
        kept = {p: now[o] for p, o in source.items() if o in now and (p in came_from or o not in left)}
        # What a file lacks keeps its column until another path has it.
        for p in paths:
            if p not in kept:
                above, _, name = p.rpartition("\x1f")
                column = ever.get(p) or (f"{kept[above]}.{name}" if above else p)
                while column in (kept.values() if p in ever else used):
                    column = f"{column}_{number}"
                kept[p] = column
            ever[p] = kept[p]
            used.add(kept[p])
        taken = set(kept.values())
        now = {p: c for p, c in now.items() if p not in kept and c not in taken} | kept
        names.append({p: now[p] for p in paths})
        for f in fields:
            column = now[f["path"]]
            seen.setdefault(column, set()).update(f["types"])
            if f["jtype"] in SCALAR:
                main.setdefault(column, f["jtype"])
    undress = {}
    for column, types in seen.items():
        if single := main.get(column) or min(types & set(SCALAR), default=None):
            undress[column] = single
        elif len(types) > 1:  # an array here, an object there
            undress[column] = "string"
    return names, undress


def compile_projections(ex: DataFrame, changes: DataFrame) -> DataFrame:
    """feed_id, file_id, names, types: for each file the map from its paths (\\x1f between names) to the feed's stable
    columns, and the type of those whose values stand in another dress somewhere, or are plain.

    A column bears the first name it had in its feed (dotted below an object); a field that returns comes back to its
    column. Where a new field takes a name that another column already bears, it gets the name with the file's number.
    A column's type is the first plain type (number, string or boolean) that most values of a file have.
    """
    schemas = file_pairs(file_schemas(ex, all_types=True)).select("feed_id", "file_id", "seq", "fields")
    steps = changes.groupBy("feed_id", "file_id").agg(F.collect_list(F.struct("change", "old_path", "new_path")).alias("steps")).select(F.col("feed_id").alias("of_feed"), F.col("file_id").alias("of_file"), "steps")
    files = schemas.join(steps, F.col("feed_id").eqNullSafe(F.col("of_feed")) & F.col("file_id").eqNullSafe(F.col("of_file")), "left").drop("of_feed", "of_file")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        names, types = assigned([(r.file_id, list(r.fields), [(s["change"], s["old_path"], s["new_path"]) for s in (r.steps if r.steps is not None else [])]) for r in f.itertuples(index=False)])
        return pd.DataFrame({"feed_id": f["feed_id"].astype("Int32").array, "file_id": f["file_id"].astype("Int32").array, "names": names, "types": [{c: types[c] for c in n.values() if c in types} for n in names]})

    return files.groupBy("feed_id").applyInPandas(run, "feed_id int, file_id int, names map<string,string>, types map<string,string>")


def spelled(v: object) -> str:
    """JSON of a value whose fractions are decimals, digits as they came."""
    if isinstance(v, list):
        return f"[{','.join(spelled(x) for x in v)}]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{spelled(x)}" for k, x in v.items()) + "}"
    return str(v) if isinstance(v, Decimal) else json.dumps(v, ensure_ascii=False)


def as_text(v: object, kind: str) -> str | None:
    """A value as its column's text: numbers in one spelling where the column's are numbers, exactly."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, dict)):
        return spelled(v)
    s = str(v)
    if kind == "boolean" and s.strip().lower() in ("true", "false"):
        return s.strip().lower()
    if kind == "number" and NUMBER.fullmatch(s.strip()):
        d = Decimal(s.strip())
        if d.is_zero():
            return "0"
        if -30 < d.adjusted() < 40:
            s = format(d, "f")
            return s.rstrip("0").rstrip(".") if "." in s else s
    return s


def unified(v: dict, names: dict[str, str], types: dict[str, str]) -> dict[str, str | None]:
    """Stable column -> text of a row's object. Objects are taken apart, so a nested field is a column of its own."""
    out: dict[str, str | None] = {}

    def put(path: str, x: object) -> None:
        column = names.get(path, dotted(path))
        kind = types.get(column)
        inner = x
        if kind:
            at = path
            while isinstance(inner, (list, dict)) and len(inner) == 1:
                if isinstance(inner, list):
                    inner, at = inner[0], None
                    continue
                (k, below), = inner.items()
                # A field that moved in here has a column of its own: this object is not its dress.
                if at is not None and names.get(f"{at}\x1f{k}", f"{column}.{k}") != f"{names.get(at, dotted(at))}.{k}":
                    break
                inner, at = below, None if at is None else f"{at}\x1f{k}"
            if isinstance(inner, (list, dict)):
                inner = x
        if isinstance(inner, dict) and inner:
            for k, below in inner.items():
                put(f"{path}\x1f{k}", below)
        else:
            out[column] = as_text(inner, kind or "")

    for k, x in v.items():
        put(k, x)
    return out


def unify(rows: DataFrame, projections: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_id, feed_id, file_id and fields (stable column -> value as text); or named columns instead of the map.

    In a column that is plain anywhere in its feed, 4, "4", ["4"] and {"value": 4} are one text; lists and objects of
    several values stay whole, objects as columns of their own (dotted). Null or invalid objects have null fields.
    """
    plan = projections.select(F.col("feed_id").alias("of_feed"), F.col("file_id").alias("of_file"), F.to_json(F.struct("names", "types")).alias("plan"))
    narrow = rows.select(F.col("row_id").cast("bigint"), F.col("feed_id").cast("int"), F.col("file_id").cast("int"), F.col("properties").cast("string").alias("p"))
    got = narrow.join(plan, F.col("feed_id").eqNullSafe(F.col("of_feed")) & F.col("file_id").eqNullSafe(F.col("of_file")), "left").drop("of_feed", "of_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, types = None, {}, {}
        sound = lambda s: s if s is None else s.encode("utf-8", "replace").decode()
        for b in batches:
            out: list = []
            for p, plan in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if plan != last:
                    read = json.loads(plan or "{}")
                    last, names, types = plan, read.get("names") or {}, read.get("types") or {}
                try:
                    v = json.loads(p or "null", parse_float=Decimal)
                except (ValueError, RecursionError):
                    v = None
                out.append([(sound(k), sound(x)) for k, x in unified(v, names, types).items()] if isinstance(v, dict) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.map_(pa.string(), pa.string()))], names=["row_id", "feed_id", "file_id", "fields"])

    got = got.mapInArrow(run, "row_id bigint, feed_id int, file_id int, fields map<string,string>")
    return got if columns is None else got.select("row_id", "feed_id", "file_id", *(F.col("fields")[c].alias(c) for c in columns))
