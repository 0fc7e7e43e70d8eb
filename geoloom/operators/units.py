"""Quantities in different units and notations, brought to common units.

A text is cut into numbers and a skeleton (the text with each number as #). A grammar reads the skeleton once:

    quantity := hedge? (upper | sum) ;  sum := term+ ;  term := number unit? ;  unit := factor (('*' | '/') factor)*
    factor := name ('²' | '³')?  ;  upper := ground '+' number | number 'above ground floor'

and gives a linear form (a coefficient for each number, a constant) with an exponent vector over the base dimensions;
the numbers are then only multiplied and added. Rows of one skeleton share one reading.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base dimensions of the exponent vectors: length, mass, time, temperature, storeys.
DIMENSIONS = ("length", "mass", "time", "temperature", "storey")
LENGTH, STOREY, NONE = (1, 0, 0, 0, 0), (0, 0, 0, 0, 1), (0, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    label: str
    dims: tuple[int, ...]
    scale: float
    offset: float = 0.0


#: Label, dimension, scale and offset to the canonical unit (m, kg, s, K, storey), spellings.
BASIC = (
    ("m", LENGTH, 1.0, 0.0, "m meter meters metre metres mètre mètres metro metros м метр метра метров"),
    ("ft", LENGTH, 0.3048, 0.0, "ft foot feet ' ′ ’ fuß fuss pie pies pied pieds фут фута футов"),
    ("in", LENGTH, 0.0254, 0.0, "in inch inches \" ″ ” zoll pouce pouces pulgada pulgadas дюйм дюйма дюймов"),
    ("yd", LENGTH, 0.9144, 0.0, "yd yds yard yards yarda yardas verge verges ярд ярда ярдов"),
    ("mi", LENGTH, 1609.344, 0.0, "mi mile miles"),
    ("storey", STOREY, 1.0, 0.0, "storey storeys story stories floor floors fl level levels etage etagen étage étages piso pisos planta plantas этаж этажа этажей"),
    ("g", (0, 1, 0, 0, 0), 0.001, 0.0, "g gram grams gramm"),
    ("s", (0, 0, 1, 0, 0), 1.0, 0.0, "s sec second seconds"),
    ("min", (0, 0, 1, 0, 0), 60.0, 0.0, "min minute minutes"),
    ("h", (0, 0, 1, 0, 0), 3600.0, 0.0, "h hr hour hours"),
    ("K", (0, 0, 0, 1, 0), 1.0, 0.0, "k kelvin"),
    ("°C", (0, 0, 0, 1, 0), 1.0, 273.15, "°c celsius"),
    ("°F", (0, 0, 0, 1, 0), 5 / 9, 459.67 * 5 / 9, "°f fahrenheit"),
)
#: SI prefixes for the metre and the gram, short and long.
PREFIXES = (("k", "kilo", 1e3), ("d", "deci", 1e-1), ("c", "centi", 1e-2), ("m", "milli", 1e-3))
HEDGES = {"ca", "circa", "approx", "approximately", "about", "~", "≈", "etwa", "environ", "aprox", "около"}
GROUND = {"g", "eg", "ground", "rdc", "pb"}
UPPER_TAIL = ("above", "ground", "floor")

NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
TOKEN = re.compile(r"#|°[a-zA-Z]|[²³]|[^\W\d_²³]+|[^\w\s]")
#: No building is higher, nor has more storeys.
MOST_METRES, MOST_STOREYS, MOST_ROOF = 1000.0, 200.0, 200.0


def _lexicon() -> dict[str, Unit]:
    out = {}
    for label, dims, scale, offset, names in BASIC:
        for n in names.split():
            out[n] = Unit(label, dims, scale, offset)
            if label in ("m", "g") and n.isascii():
                for short, long, x in PREFIXES:
                    out[(short if n in ("m", "g") else long) + n] = Unit(short + label, dims, scale * x)
    return out


LEXICON = _lexicon()


@dataclass(frozen=True)
class Form:
    """value = sum(coef * number) + const; label of the first unit, '' for a bare number, None for no quantity."""

    label: str | None
    dims: tuple[int, ...] = NONE
    coef: tuple[float, ...] = ()
    const: float = 0.0


NOTHING = Form(None)


def _unit(tokens: list[str], at: int) -> tuple[Unit | None, int]:
    """A product or quotient of named units with exponents, from tokens[at]."""
    dims, scale, first, sign, n = np.zeros(len(DIMENSIONS), int), 1.0, None, 1, 0
    while at < len(tokens):
        u = LEXICON.get(tokens[at])
        if u is None:
            break
        at += 1
        power = sign
        if at < len(tokens) and re.fullmatch(r"[²³]", tokens[at]):
            power, at = sign * (2 if tokens[at] == "²" else 3), at + 1
        dims, scale, n = dims + power * np.array(u.dims), scale * u.scale**power, n + 1
        first = first or u
        if at < len(tokens) and tokens[at] in ("*", "/", "·") and at + 1 < len(tokens) and tokens[at + 1] in LEXICON:
            sign = -1 if tokens[at] == "/" else 1
            at += 1
        else:
            break
    if first is None:
        return None, at
    plain = n == 1 and tuple(dims) == first.dims
    return Unit(first.label if plain else "compound", tuple(int(d) for d in dims), scale, first.offset if plain else 0.0), at


@lru_cache(maxsize=100_000)
def read_skeleton(skeleton: str) -> Form:
    tokens = TOKEN.findall(skeleton.lower().replace("''", '"'))
    tokens = [t for i, t in enumerate(tokens) if not (t == "." and i and tokens[i - 1] != "#")]  # the dot of an abbreviation
    while tokens and tokens[0] in HEDGES:
        tokens.pop(0)
    if len(tokens) == 3 and tokens[0] in GROUND and tokens[1:] == ["+", "#"]:
        return Form("upper", STOREY, (1.0,), 1.0)
    if tuple(tokens[1:]) == UPPER_TAIL and tokens[0] == "#":
        return Form("upper", STOREY, (1.0,), 1.0)
    sign = 1.0
    if len(tokens) > 1 and tokens[0] in ("-", "−", "+") and tokens[1] == "#":
        sign = -1.0 if tokens.pop(0) != "+" else 1.0
    coef, const, label, dims, at = [], 0.0, None, None, 0
    while at < len(tokens):
        if tokens[at] != "#":
            return NOTHING
        u, at = _unit(tokens, at + 1)
        u = u or Unit("", NONE, 1.0)
        if dims is not None and (u.dims != dims or u.offset or label == ""):
            return NOTHING  # metres and feet can be added, metres and storeys can't
        if label is None:
            label, dims = u.label, u.dims
        coef.append(sign * u.scale)
        const += u.offset
        if coef[1:] and at < len(tokens) and tokens[at] != "#":
            return NOTHING
    return Form(label, dims, tuple(coef), const) if coef else NOTHING


#: Digits in groups of three, and the unit after them: of units smaller than a metre there are thousands.
GROUPED = re.compile(r"[1-9]\d{0,2}(?:,\d{3})+(?![\d.,])(?=\s*([^\W\d_]+|[\"″”'′’]))")


def ungrouped(m: re.Match) -> str:
    u = LEXICON.get(m[1].lower())
    return m[0].replace(",", "") if u is not None and u.dims == LENGTH and u.scale < 1 else m[0]


def skeleton(text: str) -> tuple[str, list[float]]:
    """The text with # for each number, and the numbers. A comma is a decimal point, but for 12,500 mm."""
    text = GROUPED.sub(ungrouped, text)
    numbers = [float(x.replace(",", ".")) for x in NUMBER.findall(text)]
    return NUMBER.sub("#", text), numbers


def read_quantity(text: str | None) -> tuple[float | None, str | None, tuple[int, ...]]:
    """(value in canonical units, label, exponents); a bare number has label '' and stays as it is."""
    if text is None:
        return None, None, NONE
    s, numbers = skeleton(text.strip())
    f = read_skeleton(s)
    if f.label is None or len(f.coef) != len(numbers):
        return None, None, NONE
    return math.fsum(c * x for c, x in zip(f.coef, numbers, strict=True)) + f.const, f.label, f.dims


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("dims", T.ArrayType(T.IntegerType()))]))
def quantity(texts: pd.Series) -> pd.DataFrame:
    """read_quantity of each text; equal texts of a batch are read once."""
    codes, distinct = pd.factorize(texts)
    got = [read_quantity(t) for t in distinct] + [(None, None, NONE)]
    value = np.array([np.nan if g[0] is None else g[0] for g in got])[codes]
    unit = np.array([g[1] for g in got], dtype=object)[codes]
    dims = np.empty(len(got), dtype=object)
    dims[:] = [list(g[2]) for g in got]
    return pd.DataFrame({"value": value, "unit": unit, "dims": dims[codes]})


def stand_in(text: Column) -> Column:
    """A bare number that stands for 'not known': negative, or 9999, 99999 and so on."""
    return F.coalesce(F.trim(text).rlike(r"^-\s*\d|^9{4,}(\.0*)?$"), F.lit(False))


#: Position starts in GeoJSON text, with x and y.
POSITION = re.compile(r"\[\s*(-?\d[\d.eE+-]*)\s*,\s*(-?\d[\d.eE+-]*)")
EARTH_A = 6378137.0
MERCATOR_CODES = re.compile(r"(?:3857|900913|3785|102100|102113)\W*$")


def declared_mercator(crs: str | None) -> bool:
    try:
        v = json.loads(crs or "null")
    except (ValueError, RecursionError):
        v = crs
    p = v.get("properties") if isinstance(v, dict) else None
    names = [p.get(k) for k in ("name", "href", "code")] + [v.get("type")] if isinstance(p, dict) else [v.get("type")] if isinstance(v, dict) else [v]
    return any(MERCATOR_CODES.search(str(n)) for n in names if n is not None)


def lonlat_text(coordinates: str, crs: str | None) -> tuple[str, str | None]:
    """Coordinates in degrees, and EPSG:3857 if the numbers are in fact Web-Mercator metres.

    Numbers beyond ±180 / ±90 can't be degrees, whatever is declared. Where all lie within, they are degrees unless
    Web Mercator is declared and they spread over more than a degree, as no feature measured in degrees does.
    """
    pairs = POSITION.findall(coordinates)
    if not pairs:
        return coordinates, None
    try:
        xy = np.array(pairs, float)
    except ValueError:
        return coordinates, None
    far = abs(xy[0, 0]) > 180 or abs(xy[0, 1]) > 90 or np.abs(xy[:, 0]).max() > 180 or np.abs(xy[:, 1]).max() > 90
    if not far and not (np.ptp(xy, axis=0).max() > 1 and declared_mercator(crs)):
        return coordinates, None
    lon = np.degrees(xy[:, 0] / EARTH_A)
    lat = np.degrees(2 * np.arctan(np.exp(xy[:, 1] / EARTH_A)) - np.pi / 2)
    it = iter(zip(lon.tolist(), lat.tolist(), strict=True))
    return POSITION.sub(lambda _: "[%.9f,%.9f" % next(it), coordinates), "EPSG:3857"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("unit", T.StringType())]))
def lonlat(coordinates: pd.Series, crs: pd.Series) -> pd.DataFrame:
    got = [(None, None) if c is None else lonlat_text(c, r) for c, r in zip(coordinates, crs, strict=True)]
    return pd.DataFrame(got, columns=["text", "unit"], dtype=object)


#: Units a provider may use for all its bare heights, with metres per unit. Yards differ too little from metres to tell.
BARE = (("m", 1.0), ("ft", 0.3048), ("in", 0.0254), ("cm", 0.01), ("mm", 0.001))


def bare_units(measured: DataFrame, providers: DataFrame) -> DataFrame:
    """provider, bare_unit, bare_scale: the unit of each provider's bare heights, declared or not.

    The median of a provider's bare numbers is set against the median of all heights with a stated unit: the unit
    whose scale comes nearest (as a ratio) is the one used. A declared unit holds unless it is off by more than half.
    """
    value, unit = F.col("height_q.value"), F.col("height_q.unit")
    middle = lambda which: F.percentile_approx(F.when(which & (value > 0), value), 0.5, 2000)
    # One pass: the total's row has the typical stated height, the providers' rows their typical bare number.
    r = measured.rollup("provider").agg(F.grouping("provider").alias("total"), middle(unit != "").alias("stated"), middle((unit == "") & ~F.col("height_stand_in")).alias("mid"))
    # A row a provider: the window spares a second pass over all rows.
    r = r.withColumn("typical", F.max(F.when(F.col("total") == 1, F.col("stated"))).over(Window.partitionBy(F.lit(1))))
    both = r.filter("total = 0 AND mid IS NOT NULL").join(providers.select("provider", "height_unit").dropDuplicates(["provider"]), "provider", "left")
    off = lambda s: F.abs(F.ln(F.col("typical") / (F.col("mid") * F.lit(s))))
    nearest = F.array_min(F.array(*[F.struct(off(s).alias("off"), F.lit(u).alias("unit"), F.lit(s).alias("scale")) for u, s in BARE]))
    declared = F.coalesce(*[F.when((F.lower("height_unit") == u) & (off(s) < math.log(1.5)), F.struct(off(s).alias("off"), F.lit(u).alias("unit"), F.lit(s).alias("scale"))) for u, s in (*BARE, ("yd", 0.9144))])
    # Without any stated height there is nothing to compare: the declared unit, else metres.
    fallback = F.coalesce(*[F.when(F.lower("height_unit") == u, F.struct(F.lit(0.0).alias("off"), F.lit(u).alias("unit"), F.lit(s).alias("scale"))) for u, s in BARE], F.struct(F.lit(0.0).alias("off"), F.lit("m").alias("unit"), F.lit(1.0).alias("scale")))
    best = F.when(F.col("typical").isNull(), fallback).otherwise(F.coalesce(declared, nearest))
    return both.select("provider", best.alias("b")).select("provider", F.col("b.unit").alias("bare_unit"), F.col("b.scale").alias("bare_scale"))


#: Metres of a storey, for levels given as a length.
STOREY_M = 3.0


def to_common_units(features: DataFrame, providers: DataFrame) -> DataFrame:
    """row_id with lonlat (GeoJSON text in degrees), height_m, levels_n, and the units they were given in.

    height_unit is the unit of the delivered height (a bare number: its provider's), levels_unit is 'storey',
    'upper', 'm', 'ft' ..., coordinates_unit 'EPSG:3857' or null for degrees. A value that is no measurement (null,
    blank, a word, a stand-in number) gives nulls; so does a text whose terms don't add up (metres and storeys).
    Repeated rows are converted one by one; an empty table gives an empty table.
    """
    own = features.select("row_id", "provider", "coordinates", "crs", "height", "levels")
    q = own.select("row_id", "provider", lonlat("coordinates", "crs").alias("c"), quantity("height").alias("height_q"), stand_in(F.col("height")).alias("height_stand_in"), quantity("levels").alias("levels_q"), stand_in(F.col("levels")).alias("levels_stand_in"))
    # The medians are taken over all rows, in a pass of its own over two narrow columns.
    units = bare_units(features.select("provider", quantity("height").alias("height_q"), stand_in(F.col("height")).alias("height_stand_in")), providers)
    j = q.join(units, "provider", "left")
    bare = F.col("height_q.unit") == ""
    scale = F.when(bare, F.coalesce("bare_scale", F.lit(1.0))).otherwise(1.0)
    metres = F.col("height_q.value") * scale
    is_height = ~F.col("height_stand_in") & (bare | (F.col("height_q.dims") == F.array(*map(F.lit, LENGTH)))) & (metres > 0) & (metres <= MOST_METRES)
    n_unit = F.col("levels_q.unit")
    as_length = F.col("levels_q.dims") == F.array(*map(F.lit, LENGTH))
    storeys = F.when(as_length, F.greatest(F.lit(1.0), F.round(F.col("levels_q.value") / STOREY_M))).otherwise(F.col("levels_q.value"))
    is_level = ~F.col("levels_stand_in") & ((n_unit == "") | as_length | (F.col("levels_q.dims") == F.array(*map(F.lit, STOREY)))) & (storeys > 0) & (storeys <= MOST_STOREYS)
    return j.select(
        "row_id",
        F.col("c.text").alias("lonlat"),
        F.col("c.unit").alias("coordinates_unit"),
        F.when(is_height, metres).alias("height_m"),
        F.when(is_height, F.when(bare, F.coalesce("bare_unit", F.lit("m"))).otherwise(F.col("height_q.unit"))).alias("height_unit"),
        F.when(is_level, storeys).alias("levels_n"),
        F.when(is_level, F.when(n_unit == "", "storey").otherwise(n_unit)).alias("levels_unit"),
    )


def foreign_units(common: DataFrame) -> DataFrame:
    """row_id, quantity, unit of each value that was not in the common unit."""
    long = common.select("row_id", F.expr("stack(3, 'coordinates', coordinates_unit, 'height', height_unit, 'levels', levels_unit) AS (quantity, unit)"))
    return long.filter("unit IS NOT NULL AND NOT (quantity = 'height' AND unit = 'm') AND NOT (quantity = 'levels' AND unit = 'storey')")
