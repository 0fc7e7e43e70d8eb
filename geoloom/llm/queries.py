"""Queries of the text operators, with the SQL that checks them where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import encoding, history_dedup, packing, subjects
from geoloom.session import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Batch after batch through a history of its own, as they arrive."""
    return history_dedup.repeats(table(spark, d, "features"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(p8_ids(spark, d), "doc_id", "ids")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    c = p9_packed(spark, d).groupBy("spec_id", "container").agg(F.sum("size").alias("size"))
    used = c.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"))
    room = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return used.join(table(spark, d, "pack_specs"), "spec_id").select("spec_id", "containers", "tokens", F.round(room, 4).alias("fill"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: documents packed, containers over it, texts split without need, texts whose pieces don't sum to their tokens."""
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens")
    packed = cut(p9_packed(spark, d))
    over = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("size")).join(specs, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("size") > F.col("capacity_tokens")).alias("overfull"))
    size = p8_ids(spark, d).select("doc_id", F.size("ids").alias("tokens"))
    texts = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size")).join(size, "doc_id").join(specs, "spec_id")
    per_spec = texts.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split"), F.count_if(F.col("size") != F.col("tokens")).alias("unsound"))
    return per_spec.join(over, "spec_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "items").select(F.col("item_name").alias("name"))
    return subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "doc_labels"), names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p8_ids, p8_decoded, p9_packed, p9_fill, p9_checked, p10_found)}

_R = "6378137.0"
#: Shapes of equal extent, all corners of either against all edges of the other. What repeats a row has the earliest one
#: it matches: that one matches no earlier one where all that match one another stem from one original, as here.
_P3 = f"""WITH t AS (SELECT row_id, coalesce(batch_no, 2147483647) AS batch, CASE geometry_type WHEN 'LineString' THEN 'MultiLineString' WHEN 'MultiPolygon' THEN 'Polygon' ELSE geometry_type END AS kind,
  CASE geometry_type WHEN 'Point' THEN [[try_cast(coordinates::JSON AS DOUBLE[])]] WHEN 'LineString' THEN [try_cast(coordinates::JSON AS DOUBLE[][])] WHEN 'MultiPoint' THEN [try_cast(coordinates::JSON AS DOUBLE[][])] WHEN 'MultiPolygon' THEN flatten(try_cast(coordinates::JSON AS DOUBLE[][][][])) ELSE try_cast(coordinates::JSON AS DOUBLE[][][]) END AS rings FROM features WHERE json_valid(coordinates)),
r AS (SELECT row_id, kind, unnest(range(len(rings))) AS ring, unnest(rings) AS ps FROM t),
c0 AS (SELECT row_id, kind, ring, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM r),
c1 AS (SELECT row_id, kind, ring, i, p[1] AS x, p[2] AS y, max(CASE WHEN abs(p[1]) > 180 OR abs(p[2]) > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id) AS metres FROM c0),
c AS (SELECT row_id, kind, ring, i, CASE metres WHEN 1 THEN x ELSE radians(x)*{_R} END AS x, CASE metres WHEN 1 THEN y ELSE {_R}*ln(tan(pi()/4 + radians(y)/2)) END AS y FROM c1),
s AS (SELECT row_id, ring, x AS ax, y AS ay, coalesce(lead(x) OVER w, CASE kind WHEN 'Polygon' THEN first_value(x) OVER w ELSE x END) AS bx, coalesce(lead(y) OVER w, CASE kind WHEN 'Polygon' THEN first_value(y) OVER w ELSE y END) AS by FROM c WINDOW w AS (PARTITION BY row_id, ring ORDER BY i)),
b AS (SELECT row_id, kind, batch, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, 0.5*cosh(avg(y)/{_R}) AS tol FROM c JOIN t USING (row_id, kind) GROUP BY ALL),
pairs AS (SELECT p.row_id AS a, q.row_id AS b, p.tol FROM b p JOIN b q ON p.kind = q.kind AND q.x0 BETWEEN p.x0 - p.tol AND p.x0 + p.tol AND q.y0 BETWEEN p.y0 - p.tol AND p.y0 + p.tol AND abs(p.x1 - q.x1) <= p.tol AND abs(p.y1 - q.y1) <= p.tol AND (p.batch, p.row_id) < (q.batch, q.row_id)),
both_ways AS (SELECT a, b, tol, a AS corners, b AS outline FROM pairs UNION ALL SELECT a, b, tol, b, a FROM pairs),
near AS (SELECT w.a, w.b, w.tol, w.corners, c.ring, c.i, min(pow(c.x - s.ax - u*(s.bx - s.ax), 2) + pow(c.y - s.ay - u*(s.by - s.ay), 2)) AS d2 FROM both_ways w JOIN c ON c.row_id = w.corners JOIN (SELECT * FROM s) s ON s.row_id = w.outline,
  LATERAL (SELECT greatest(0.0, least(1.0, coalesce(((c.x - s.ax)*(s.bx - s.ax) + (c.y - s.ay)*(s.by - s.ay))/nullif(pow(s.bx - s.ax, 2) + pow(s.by - s.ay, 2), 0), 0.0))) AS u) GROUP BY ALL),
same AS (SELECT a, b FROM near GROUP BY a, b HAVING max(d2/(tol*tol)) <= 1.0)
SELECT m.first AS row_a, m.b AS row_b FROM (SELECT b, arg_min(a, (t.batch, a)) AS first FROM same JOIN t ON t.row_id = a GROUP BY b) m"""

#: Decoding gives the texts back; the other operators have no SQL form and are tested against brute force.
ORACLES: dict[str, str] = {"p3_found": _P3, "p9_checked": "SELECT spec_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS unsound FROM pack_specs", "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
