"""Rows that fail to parse: valid records load, the others come out with a reason.

Records arrive one per row (line breaks inside a record kept). Blocks of records are parsed at once by Arrow's
CSV reader under columnar checks; a block that fails is halved again and again until the bad records stand alone,
and only those go through the strict character-level reader that names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block that fails is halved; below this size each record is looked at by itself.
LEAF = 4
BLOCK = 256

FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
RECORD = re.compile(rf"\A{FIELD}(?:,{FIELD}){{3}}\Z", re.DOTALL)
RECORD_RE2 = rf"(?s)\A{FIELD}(?:,{FIELD}){{3}}\z"
NUMBER = re.compile(r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*\Z")
NUMBER_RE2 = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*\z"
#: Control characters other than tab and line feed, and the replacement character.
FOUL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f�]")
FOUL_RE2 = r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"

REASONS = ("quoting", "columns", "value")
OUT = pa.schema([("latitude", pa.float64()), ("longitude", pa.float64()), ("short_description", pa.string()), ("long_description", pa.string()), ("reason", pa.string())])


def split_record(raw: str) -> tuple[list[str], bool]:
    """Fields of one record and whether its quoting is sound (RFC 4180, no blanks around quotes)."""
    fields, at, end = [], 0, len(raw)
    while True:
        if at < end and raw[at] == '"':
            parts, at = [], at + 1
            while True:
                to = raw.find('"', at)
                if to < 0:
                    return fields, False
                parts.append(raw[at:to])
                if raw[to + 1 : to + 2] == '"':
                    parts.append('"')
                    at = to + 2
                else:
                    at = to + 1
                    break
            if at < end and raw[at] != ",":
                return fields, False
            fields.append("".join(parts))
        else:
            to = raw.find(",", at)
            to = end if to < 0 else to
            if '"' in raw[at:to]:
                return fields, False
            fields.append(raw[at:to])
            at = to
        if at >= end:
            return fields, True
        at += 1  # the comma


def degrees(text: str, most: float) -> float | None:
    if not NUMBER.match(text) or not text.isascii():
        return None
    x = float(text)
    return x if -most <= x <= most else None


def diagnose(raw: str | None) -> tuple:
    """(latitude, longitude, short, long, reason) of one record, read strictly."""
    fields, sound = split_record(raw or "")
    if not sound:
        return None, None, None, None, "quoting"
    if len(fields) != 4:
        return None, None, None, None, "columns"
    lat, lon = degrees(fields[0], 90), degrees(fields[1], 180)
    if lat is None or lon is None or not fields[2].strip() or FOUL.search(fields[2]) or FOUL.search(fields[3]):
        return None, None, None, None, "value"
    return lat, lon, fields[2], fields[3], None


def _bulk(raws: pa.Array) -> list[pa.Array] | None:
    """The four typed columns of a whole block, or None if any record in it is not plainly valid."""
    n = len(raws)
    if raws.null_count or not pc.all(pc.match_substring_regex(raws, RECORD_RE2)).as_py():
        return None
    # Each record is led by its place; if a quote swallowed a neighbour, places and counts no longer agree.
    led = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(n)), pa.string()), raws, ",")
    data = "\n".join(led.to_pylist()).encode()
    try:
        got = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(column_names=["seq", "lat", "lon", "short", "long"], use_threads=False, block_size=len(data) + 1),
            pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types={"seq": pa.int64()} | dict.fromkeys(("lat", "lon", "short", "long"), pa.string()), strings_can_be_null=False, null_values=[]),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows != n or not np.array_equal(got["seq"].to_numpy(), np.arange(n)):
        return None
    lat_s, lon_s, short, long_ = (got[c].combine_chunks() for c in ("lat", "lon", "short", "long"))
    if not all(pc.all(pc.match_substring_regex(x, NUMBER_RE2)).as_py() for x in (lat_s, lon_s)):
        return None
    lat, lon = (pc.cast(pc.ascii_trim_whitespace(pc.replace_substring_regex(x, r"\A\s*\+", "")), pa.float64()) for x in (lat_s, lon_s))
    if pc.max(pc.abs(lat)).as_py() > 90 or pc.max(pc.abs(lon)).as_py() > 180:
        return None
    if pc.any(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(short)), 0)).as_py():
        return None
    if any(pc.any(pc.match_substring_regex(x, FOUL_RE2)).as_py() for x in (short, long_)):
        return None
    return [lat, lon, short, long_]


def parse_block(raws: pa.Array) -> pa.Table:
    """OUT rows for the records, in order: whole blocks where they are clean, halves where they are not."""
    good: list[tuple[int, list[pa.Array]]] = []
    rows: list[tuple[int, tuple]] = []
    todo = [(at, min(at + BLOCK, len(raws))) for at in range(0, len(raws), BLOCK)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            rows += [(k, diagnose(raws[k].as_py())) for k in range(lo, hi)]
            continue
        got = _bulk(raws.slice(lo, hi - lo))
        if got is None:
            mid = (lo + hi) // 2
            todo += [(lo, mid), (mid, hi)]
        else:
            good.append((lo, got))
    tables = [pa.table([pa.array(np.arange(lo, lo + len(g[0]))), *g, pa.nulls(len(g[0]), pa.string())], names=["at", *OUT.names]) for lo, g in good]
    if rows:
        tables.append(pa.table([pa.array([k for k, _ in rows])] + [pa.array([r[i] for _, r in rows], OUT.types[i]) for i in range(5)], names=["at", *OUT.names]))
    if not tables:
        return OUT.empty_table()
    return pa.concat_tables(tables).sort_by("at").drop_columns(["at"]).cast(OUT)


def parse_records(df: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """df's records as columns latitude, longitude, short_description, long_description and reason.

    reason is null for a record that loads; else the first of quoting, columns and value that holds, and the four
    values are null. A null or empty record is 'columns'. An empty long description is valid and stays ''. An empty
    table gives an empty table; columns of df outside keep are dropped, so names cannot clash; ties and repeated
    rows are kept row for row. Very long records are read like any other.
    """
    clash = set(keep) & set(OUT.names)
    if clash:
        raise ValueError(f"keep has names of the result: {sorted(clash)}")
    narrow = df.select(*keep, F.col(raw).cast("string").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            raws = t["__raw"].combine_chunks()
            got = parse_block(raws.cast(pa.string()) if not pa.types.is_string(raws.type) else raws)
            for c in reversed(keep):
                got = got.add_column(0, c, t[c])
            yield from got.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__raw")
    return narrow.mapInArrow(run, f"{fields}, latitude double, longitude double, short_description string, long_description string, reason string")


def is_header(line_no: Column) -> Column:
    """Line 1 of each file is its header."""
    return F.coalesce(line_no == 1, F.lit(False))


def load_jcsu(lines: DataFrame) -> DataFrame:
    """All records of jcsu_lines except the files' headers, loaded or with the reason for refusal."""
    return parse_records(lines.filter(~is_header(F.col("line_no"))), "raw", ("line_id", "file_name", "line_no"))
