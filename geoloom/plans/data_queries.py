"""Queries of the data-pipeline operators: pN_..., each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import bad_rows, hotdeck, nested, proximity, schema_drift, units
from geoloom.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.load_jcsu(table(spark, d, "jcsu_lines")).filter("reason IS NOT NULL").select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.load_jcsu(table(spark, d, "jcsu_lines")).filter("reason IS NULL").drop("reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # The node table is written in full, content and all; the children are read from it.
    return nested.children(cut(p2_nodes(spark, d)))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(table(spark, d, "geojson_pages"))


def p2_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes lie below each feature, by its labels alone."""
    return p2_nodes(spark, d).filter("kind = 'feature'").select("page_id", "feature_no", (F.col("post") - F.col("pre") + 1).alias("n_below"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_units(p4_common(spark, d))


def p4_common(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(table(spark, d, "features"), table(spark, d, "providers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.top_level(schema_drift.schema_changes(table(spark, d, "feed_rows")))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_rows")
    fields = schema_drift.parsed(rows)
    names = schema_drift.compile_projections(fields, schema_drift.schema_changes(rows, fields))
    return schema_drift.unify(rows, names).withColumn("fields", F.to_json("fields"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.point_joins(table(spark, d, "jcsu_points"), table(spark, d, "zones"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """p6_found with one class for all points at a position."""
    return proximity.class_joins(table(spark, d, "jcsu_points"), table(spark, d, "zones"))


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.fill_buildings(table(spark, d, "features"), table(spark, d, "providers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # The filled table is written in full; what was missing is read from its marks.
    return hotdeck.filled_values(cut(p7_filled(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_nodes, p2_subtrees, p4_found, p4_common, p5_found, p5_unified, p6_found, p6_classes, p7_found, p7_filled)
}


# --- SQL that checks them, written independently of the operators ---------------------------------------------------

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_GROUP = r'("(?:[^"]|"")*"|[^",]*)'
_OPEN = f"^{_FIELD}(,{_FIELD})*$"
_FOUR = f"^{_GROUP},{_GROUP},{_GROUP},{_GROUP}$"


def _field(i: int) -> str:
    g = f"regexp_extract(raw, '{_FOUR}', {i}, 's')"
    return f"CASE WHEN starts_with({g}, '\"') THEN replace({g}[2:-2], '\"\"', '\"') ELSE {g} END"


_FOUL = r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"
_NUM = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*"
_P1 = f"""WITH r AS (SELECT line_id, raw, regexp_full_match(raw, '{_OPEN}', 's') AS sound, regexp_full_match(raw, '{_FOUR}', 's') AS four FROM jcsu_lines WHERE line_no <> 1),
f AS (SELECT *, {_field(1)} AS a, {_field(2)} AS b, {_field(3)} AS s, {_field(4)} AS l FROM r),
v AS (SELECT *, regexp_full_match(a, '{_NUM}') AND regexp_full_match(b, '{_NUM}') AND coalesce(abs(try_cast(trim(a) AS DOUBLE)) <= 90 AND abs(try_cast(trim(b) AS DOUBLE)) <= 180, false) AND trim(s, E' \\t\\n') <> '' AND NOT regexp_matches(s, '{_FOUL}') AND NOT regexp_matches(l, '{_FOUL}') AS ok FROM f)
SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN NOT four THEN 'columns' ELSE 'value' END AS reason FROM v WHERE NOT sound OR NOT four OR NOT ok"""

_NONE = "({c} IS NULL OR NOT regexp_matches({c}, '[0-9]') OR regexp_full_match(trim({c}), '-.*|9{{4,}}'))"
_P7 = " UNION ALL ".join(f"SELECT row_id, '{c}' AS field FROM features WHERE geometry_type IN ('Polygon', 'MultiPolygon') AND {_NONE.format(c=c)}" for c in ("height", "levels", "roof_height"))

_BARE = r"[0-9]+([.,][0-9]+)?"
_P4 = f"""WITH f AS (SELECT row_id, provider, coordinates, lower(trim(height)) AS h, lower(trim(levels)) AS l, {_NONE.format(c="height")} AS no_h, {_NONE.format(c="levels")} AS no_l FROM features),
u AS (SELECT *, CASE WHEN no_h THEN NULL WHEN regexp_full_match(h, '{_BARE}') THEN '' WHEN regexp_matches(h, '''|′|ft|feet|foot|fuß|pie') THEN 'ft' WHEN regexp_matches(h, '"|in') THEN 'in' WHEN regexp_matches(h, 'yd|yard') THEN 'yd' WHEN regexp_matches(h, 'cm') THEN 'cm' WHEN regexp_matches(h, 'mm') THEN 'mm' ELSE 'm' END AS hu FROM f),
med AS (SELECT provider, median(CAST(replace(h, ',', '.') AS DOUBLE)) AS m FROM u WHERE hu = '' GROUP BY provider),
typ AS (SELECT median(CAST(replace(regexp_extract(h, '{_BARE}'), ',', '.') AS DOUBLE)) AS t FROM u WHERE hu = 'm'),
bare AS (SELECT provider, arg_min(unit, abs(ln(t/(m*scale)))) AS bu FROM med, typ, (VALUES ('m', 1.0), ('ft', 0.3048), ('in', 0.0254), ('cm', 0.01), ('mm', 0.001)) x(unit, scale) GROUP BY provider)
SELECT row_id, 'coordinates' AS quantity, 'EPSG:3857' AS unit FROM f WHERE abs(CAST(regexp_extract(coordinates, '-?[0-9.]+') AS DOUBLE)) > 180 OR abs(CAST(regexp_extract(coordinates, '-?[0-9.]+,(-?[0-9.]+)', 1) AS DOUBLE)) > 90
UNION ALL SELECT row_id, 'height', CASE hu WHEN '' THEN bu ELSE hu END FROM u LEFT JOIN bare USING (provider) WHERE NOT no_h AND CASE hu WHEN '' THEN bu ELSE hu END <> 'm'
UNION ALL SELECT row_id, 'levels', CASE WHEN regexp_matches(l, '^(g|eg|ground) ?[+]|above') THEN 'upper' WHEN regexp_matches(l, '''|ft') THEN 'ft' ELSE 'm' END FROM f WHERE NOT no_l AND NOT regexp_full_match(l, '{_BARE}|{_BARE} ?(storeys?|floors?|etagen?|fl[.]?)')"""

_ON = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
_P6 = f"""WITH p AS (SELECT point_id, latitude AS y, longitude AS x FROM jcsu_points WHERE {_ON}),
z AS (SELECT zone_id, unnest(CASE geometry_type WHEN 'Polygon' THEN CAST(coordinates AS JSON)::DOUBLE[][][] ELSE flatten(CAST(coordinates AS JSON)::DOUBLE[][][][]) END) AS ring FROM zones),
e AS (SELECT zone_id, ring[i][1] AS xa, ring[i][2] AS ya, ring[i + 1][1] AS xb, ring[i + 1][2] AS yb FROM (SELECT zone_id, ring, unnest(range(1, len(ring))) AS i FROM z))
SELECT 'near' AS kind, a.point_id AS key_a, b.point_id AS key_b FROM p a JOIN p b ON b.y BETWEEN a.y - 0.001 AND a.y + 0.001 AND a.point_id < b.point_id
WHERE 2*6371008.8*asin(sqrt(pow(sin(radians(b.y - a.y)/2), 2) + cos(radians(a.y))*cos(radians(b.y))*pow(sin(radians(b.x - a.x)/2), 2))) <= 30
UNION ALL SELECT 'inside', point_id, zone_id FROM p JOIN e ON (ya > y) <> (yb > y) AND x < (xb - xa)*(y - ya)/(yb - ya) + xa GROUP BY point_id, zone_id HAVING count(*) % 2 = 1"""

_P6_CLASSES = f"""WITH p AS (SELECT min(point_id) AS point_id, latitude AS y, longitude AS x FROM jcsu_points WHERE {_ON} AND point_id IS NOT NULL GROUP BY latitude, longitude),
""" + _P6[_P6.index("z AS (") :] + f" UNION ALL SELECT DISTINCT 'member', point_id, min(point_id) OVER (PARTITION BY latitude, longitude) FROM jcsu_points WHERE {_ON}"

_P5 = """WITH r AS (SELECT row_id, feed_id, file_id, exported_at, properties, coalesce(json_extract_string(properties, '$.OBJECTID'), json_extract_string(properties, '$.id')) AS rec FROM feed_rows WHERE json_valid(properties)),
k AS (SELECT row_id, feed_id, file_id, exported_at, rec, key, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'NULL' THEN NULL ELSE lower(type) END AS t,
  CASE type WHEN 'ARRAY' THEN json_extract_string(value, '$[0]') WHEN 'OBJECT' THEN json_extract_string(value, '$.*')[1] ELSE json_extract_string(value, '$') END AS v FROM (SELECT r.*, e.key, e.type, e.value FROM r, json_each(r.properties) e)),
n AS (SELECT *, coalesce(CAST(try_cast(trim(v) AS DOUBLE) AS VARCHAR), trim(v)) AS w FROM k),
files AS (SELECT feed_id, file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY min(exported_at), file_id) AS prev FROM n GROUP BY feed_id, file_id),
kt AS (SELECT feed_id, file_id, key, arg_min(t, {'n': -c, 't': t}) FILTER (t IS NOT NULL) AS t FROM (SELECT feed_id, file_id, key, t, count(*) AS c FROM n GROUP BY ALL) GROUP BY ALL),
gone AS (SELECT f.feed_id, f.file_id, f.prev, o.key FROM files f JOIN kt o ON o.feed_id = f.feed_id AND o.file_id = f.prev WHERE NOT EXISTS (SELECT 1 FROM kt x WHERE x.feed_id = f.feed_id AND x.file_id = f.file_id AND x.key = o.key)),
came AS (SELECT f.feed_id, f.file_id, f.prev, o.key FROM files f JOIN kt o ON o.feed_id = f.feed_id AND o.file_id = f.file_id WHERE f.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kt x WHERE x.feed_id = f.feed_id AND x.file_id = f.prev AND x.key = o.key)),
gv AS (SELECT g.feed_id, g.file_id, n.rec, g.key, max(n.w) AS w FROM gone g JOIN n ON n.feed_id = g.feed_id AND n.file_id = g.prev AND n.key = g.key WHERE n.w IS NOT NULL AND n.rec IS NOT NULL GROUP BY ALL),
cv AS (SELECT g.feed_id, g.file_id, n.rec, g.key, max(n.w) AS w FROM came g JOIN n ON n.feed_id = g.feed_id AND n.file_id = g.file_id AND n.key = g.key WHERE n.w IS NOT NULL AND n.rec IS NOT NULL GROUP BY ALL),
ren AS (SELECT gv.feed_id, gv.file_id, gv.key AS o, cv.key AS c FROM gv JOIN cv USING (feed_id, file_id, rec) GROUP BY ALL HAVING avg(CASE WHEN gv.w = cv.w THEN 1.0 ELSE 0.0 END) >= 0.7)
SELECT file_id, 'renamed' AS change, o AS old_field, c AS new_field FROM ren
UNION ALL SELECT file_id, 'removed', key, '' FROM gone WHERE (feed_id, file_id, key) NOT IN (SELECT (feed_id, file_id, o) FROM ren)
UNION ALL SELECT file_id, 'added', '', key FROM came WHERE (feed_id, file_id, key) NOT IN (SELECT (feed_id, file_id, c) FROM ren)
UNION ALL SELECT f.file_id, 'retyped', a.key, a.key FROM files f JOIN kt a ON a.feed_id = f.feed_id AND a.file_id = f.file_id JOIN kt b ON b.feed_id = f.feed_id AND b.file_id = f.prev AND b.key = a.key WHERE a.t <> b.t"""



def _content(x: str) -> str:
    """JSON given as text in a string, as JSON."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"


def _array(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN json_array({x}) ELSE '[]'::JSON END"


def _each(x: str) -> str:
    return f"unnest(range(CAST(json_array_length({x}) AS BIGINT)))"


_P2 = f"""WITH b AS (SELECT page_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM geojson_pages),
c AS (SELECT page_id, coalesce(json_extract(j, '$.features'), json_extract(j, '$.data.features')) AS fs FROM b),
f0 AS (SELECT page_id, fs, {_each("fs")} AS no FROM c WHERE json_type(fs) = 'ARRAY'),
f AS (SELECT page_id, no, {_content("json_extract(fs, '$[' || no || ']')")} AS f FROM f0),
g AS (SELECT page_id, no, {_content("json_extract(f, '$.properties')")} AS p, {_content("json_extract(f, '$.geometry')")} AS g FROM f WHERE json_type(f) = 'OBJECT'),
m0 AS (SELECT page_id, no, 0 AS m, g FROM g WHERE g->>'$.type' <> 'GeometryCollection' UNION ALL SELECT page_id, no, m, json_extract(gs, '$[' || m || ']') FROM (SELECT page_id, no, gs, {_each("gs")} AS m FROM (SELECT page_id, no, {_array("json_extract(g, '$.geometries')")} AS gs FROM g WHERE g->>'$.type' = 'GeometryCollection'))),
m1 AS (SELECT page_id, no, m, g->>'$.type' AS t, {_content("json_extract(g, '$.coordinates')")} AS c FROM m0),
m AS (SELECT *, coalesce(sum(CASE WHEN t LIKE 'Multi%' THEN json_array_length(c)::BIGINT ELSE 1 END) OVER (PARTITION BY page_id, no ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM m1),
parts AS (SELECT page_id, no, t, off + k AS part, json_extract(c, '$[' || k || ']') AS c FROM (SELECT *, {_each("c")} AS k FROM m WHERE t LIKE 'Multi%' AND json_type(c) = 'ARRAY') UNION ALL SELECT page_id, no, t, off, c FROM m WHERE t NOT LIKE 'Multi%'),
rings AS (SELECT page_id, no, part, i AS item, json_extract(c, '$[' || i || ']') AS c FROM (SELECT *, {_each("c")} AS i FROM parts WHERE t LIKE '%Polygon' AND json_type(c) = 'ARRAY') UNION ALL SELECT page_id, no, part, 0, c FROM parts WHERE t NOT LIKE '%Polygon'),
o AS (SELECT page_id, no, p FROM g WHERE json_type(p) = 'OBJECT'),
l AS (SELECT page_id, no, 'source' AS child, {_content("json_extract(p, '$.sources')")} AS v FROM o UNION ALL SELECT page_id, no, 'name', {_content("json_extract(p, '$.names.common')")} FROM o UNION ALL SELECT page_id, no, 'address', {_content("json_extract(p, '$.addresses')")} FROM o),
i0 AS (SELECT page_id, no, child, v, {_each("v")} AS i FROM (SELECT page_id, no, child, {_array("v")} AS v FROM l)),
i AS (SELECT page_id, no, child, i, json_extract(v, '$[' || i || ']') AS v FROM i0),
u0 AS (SELECT page_id, no, i, {_content("json_extract(v, '$.units')")} AS u FROM i WHERE child = 'address'),
u AS (SELECT page_id, no, i, u, {_each("u")} AS k FROM (SELECT page_id, no, i, {_array("u")} AS u FROM u0))
SELECT page_id, no::INTEGER AS feature_no, 'ring' AS child, part::INTEGER AS part_no, item::INTEGER AS item_no FROM rings WHERE json_type(c) = 'ARRAY' AND json_array_length(c) > 0
UNION ALL SELECT page_id, no::INTEGER, child, 0, i::INTEGER FROM i WHERE json_type(v) <> 'NULL'
UNION ALL SELECT page_id, no::INTEGER, 'unit', i::INTEGER, k::INTEGER FROM u WHERE json_type(json_extract(u, '$[' || k || ']')) <> 'NULL'"""

_KIDS = _P2.index("SELECT page_id, no::INTEGER AS feature_no")
_P2_SUBTREES = f"{_P2[:_KIDS].rstrip()}, kids AS ({_P2[_KIDS:]}) SELECT page_id, no::INTEGER AS feature_no, count(child) AS n_below FROM g LEFT JOIN kids ON kids.page_id = g.page_id AND feature_no = no GROUP BY ALL".replace("SELECT page_id, no::INTEGER AS feature_no, count", "SELECT g.page_id, no::INTEGER AS feature_no, count")

ORACLES: dict[str, str] = {"p2_found": _P2, "p2_subtrees": _P2_SUBTREES, "p5_found": _P5, "p1_found": _P1, "p4_found": _P4, "p6_found": _P6, "p6_classes": _P6_CLASSES, "p7_found": _P7}
